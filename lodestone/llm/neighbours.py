"""Most similar vectors of every vector: vantage-point trees per shard.

A top tree over a bounded sample divides the space into shards; each shard has a tree of its own.
Both prune by the triangle inequality on chord distances of the unit vectors, with the radius
divided by a relaxation factor: 1 restores exact search, larger values visit less.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Vectors from which the top tree is fitted; the index itself holds every vector.
SAMPLE = 8192
#: Vectors a shard is meant for, and a tree's leaf.
SHARD, LEAF = 40_000, 256
#: Questions that one task answers for a part of a shard, as a multiple of SHARD; more are sliced, and each slice gets the part.
SLICE = 8
#: How unit vectors travel: as they are if the search is to be exact, else as 32-bit numbers (the error of a distance is below 1e-7). All scores are computed from 64-bit numbers.
EXACT, SHORT, SLACK = "<f8", "<f4", 2e-7


class VantageTree:
    """A tree over the rows of ``units`` (unit vectors); ``order`` lists them leaf by leaf."""

    def __init__(self, units: np.ndarray, leaf: int, seed: int = 7):
        self.random = np.random.default_rng(seed)
        self.nodes: list[tuple] = []  # (vantage, radius, inner, outer), or (start, end) of a leaf
        self.order = np.empty(len(units), np.int64)
        self.filled = 0
        self.root = self._build(units, np.arange(len(units)), leaf)
        self.units = np.ascontiguousarray(units[self.order])

    def _build(self, units: np.ndarray, rows: np.ndarray, leaf: int) -> int:
        number = len(self.nodes)
        self.nodes.append(())
        if len(rows) > leaf:
            at = rows[self._vantage(units, rows)]
            far = chord(units[rows] @ units[at])
            radius = float(np.median(far))
            inside = far <= radius
            if 0 < inside.sum() < len(rows):
                self.nodes[number] = (units[at], radius, self._build(units, rows[inside], leaf), self._build(units, rows[~inside], leaf))
                return number
        self.order[self.filled : self.filled + len(rows)] = rows
        self.nodes[number] = (self.filled, self.filled + len(rows))
        self.filled += len(rows)
        return number

    def _vantage(self, units: np.ndarray, rows: np.ndarray) -> int:
        """Of a few candidates the one whose distances to a few others spread most."""
        tried = self.random.choice(len(rows), min(16, len(rows)), replace=False)
        others = units[rows[self.random.choice(len(rows), min(256, len(rows)), replace=False)]]
        spread = chord(others @ units[rows[tried]].T).std(axis=0)
        return int(tried[np.argmax(spread)])

    def leaves(self, number: int | None = None) -> list[int]:
        """The numbers of the leaves, in order."""
        number = self.root if number is None else number
        node = self.nodes[number]
        return [number] if len(node) == 2 else self.leaves(node[2]) + self.leaves(node[3])

    def homes(self, queries: np.ndarray) -> np.ndarray:
        """The leaf each query falls into."""
        out = np.empty(len(queries), np.int64)
        work = [(self.root, np.arange(len(queries)))]
        while work:
            number, rows = work.pop()
            node = self.nodes[number]
            if len(node) == 2:
                out[rows] = number
            elif len(rows):
                inside = chord(queries[rows] @ node[0]) <= node[1]
                work += [(node[2], rows[inside]), (node[3], rows[~inside])]
        return out

    def reached(self, queries: np.ndarray, radii: np.ndarray):
        """(leaf, rows of the queries) of every leaf that a ball of ``radii`` around the query may touch.

        ``radii`` may shrink while the caller works on a leaf; it is read again at every node.
        """
        work = [(self.root, np.arange(len(queries)))]
        while work:
            number, rows = work.pop()
            node = self.nodes[number]
            if not len(rows):
                continue
            if len(node) == 2:
                yield number, rows
            else:
                off = chord(queries[rows] @ node[0]) - node[1]
                work += [(node[3], rows[off + radii[rows] > 0]), (node[2], rows[off - radii[rows] <= 0])]


def chord(cosines: np.ndarray) -> np.ndarray:
    """Distance of unit vectors with these cosines."""
    return np.sqrt(np.maximum(2.0 - 2.0 * cosines, 0.0))


class Best:
    """The k highest (score, id) of each query so far, ties to the lower id."""

    def __init__(self, count: int, k: int):
        self.scores = np.full((count, k), -2.0)
        self.ids = np.full((count, k), np.iinfo(np.int64).max, np.int64)

    def offer(self, rows: np.ndarray, own: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores``: rows x candidates; ``own``: the queries' ids, never their own candidates; ``ids`` of the candidates."""
        better = scores.max(axis=1) > self.scores[rows, -1]
        rows, own, scores = rows[better], own[better], scores[better]
        if not len(rows):
            return
        scores[own[:, None] == ids[None, :]] = -3.0
        k = self.scores.shape[1]
        if scores.shape[1] > k:
            top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
            scores, ids = np.take_along_axis(scores, top, 1), ids[top]
        else:
            ids = np.broadcast_to(ids, scores.shape)
        scores = np.concatenate([self.scores[rows], scores], axis=1)
        ids = np.concatenate([self.ids[rows], ids], axis=1)
        best = np.lexsort((ids, -scores), axis=1)[:, :k]
        self.scores[rows], self.ids[rows] = np.take_along_axis(scores, best, 1), np.take_along_axis(ids, best, 1)


def search(tree: VantageTree, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, factor: float, known: np.ndarray | None = None) -> Best:
    """The k best other vectors of ``tree`` (``ids`` in its order) for each query.

    ``known``: the k-th best score that each query has reached elsewhere; only better ones are of use
    then. Without it a query's own leaf is searched first, and then, since its radius is still too
    wide, the leaves within a third of the relaxed radius, before those within all of it.
    """
    best = Best(len(queries), k)
    leaf_row = {number: i for i, number in enumerate(tree.leaves())}
    seen = np.zeros((len(leaf_row), len(queries)), bool)
    if known is not None:
        best.scores[:] = known[:, None]
    bound = best.scores[:, -1]

    def look(number: int, rows: np.ndarray) -> None:
        start, end = tree.nodes[number]
        seen[leaf_row[number], rows] = True
        for a in range(0, len(rows), 4096):
            part = rows[a : a + 4096]
            best.offer(part, query_ids[part], queries[part] @ tree.units[start:end].T, ids[start:end])

    if known is None:
        homes = tree.homes(queries)
        order = np.argsort(homes, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(homes[order])) + 1):
            if len(part):
                look(int(homes[part[0]]), part)
    for relaxed in (factor,) if known is not None or factor <= 1 else (3 * factor, factor):
        for number, rows in tree.reached(queries, _Radii(bound, relaxed)):
            rows = rows[~seen[leaf_row[number], rows]]
            if len(rows):
                look(number, rows)
    return best


def relaxed_radius(kth: np.ndarray, factor: float) -> np.ndarray:
    """The pruning radius of queries whose k-th best score so far is ``kth``; without bound while they have fewer than k.

    SLACK is more than the distances in a tree can be off, so rounding prunes nothing.
    """
    return np.where(kth < -1.5, 4.0, chord(np.maximum(kth, -1.0)) / factor + SLACK)


class _Radii:
    """Pruning radii of the queries: the distance of the k-th best so far over the factor."""

    def __init__(self, bound: np.ndarray, factor: float):
        self.bound, self.factor = bound, factor

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        return relaxed_radius(self.bound[rows], self.factor)


def units_of(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, unit vectors) of the usable vectors in a list column: ``size`` finite numbers, not all zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    rows = np.flatnonzero((lengths == size) & np.asarray(column.is_valid()))
    flat = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    if not len(rows):
        return rows, np.zeros((0, size))
    matrix = flat[column.offsets.to_numpy()[rows][:, None] + np.arange(size)]
    largest = np.abs(matrix).max(axis=1)
    usable = np.isfinite(largest) & (largest > 0)
    matrix = matrix[usable] / largest[usable][:, None]
    return rows[usable], matrix / np.linalg.norm(matrix, axis=1)[:, None]


def packed(units: np.ndarray, kind: str) -> pa.Array:
    """Unit vectors, one binary a row."""
    data = np.ascontiguousarray(units, kind)
    ends = np.arange(len(data) + 1, dtype=np.int32) * (data.shape[1] * data.dtype.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def unpacked(column, size: int, kind: str) -> np.ndarray:
    """The unit vectors of a binary column without nulls."""
    raw = np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, size).astype(np.float64)
    return raw if kind == EXACT else raw / np.linalg.norm(raw, axis=1)[:, None]


def grouped(rows: list[np.ndarray], labels: list[int], count: int, dtype) -> pa.Array:
    """For each of ``count`` rows the list of the labels under which it was named."""
    at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    what = np.repeat(np.array(labels, np.int64), [len(r) for r in rows]) if rows else at
    order = np.argsort(at, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=count))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(what[order], dtype))


def nearest(df: DataFrame, key: str, vector: str, size: int, k: int = 5, factor: float = 4.0, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """(``key``, neighbour, cosine): the ``k`` most similar other vectors of every usable vector.

    Usable: ``size`` finite numbers, not all zero, unique ``key``; others neither ask nor answer. Ties
    and repeated vectors under other keys count as neighbours (ties in any order); fewer than k others
    give fewer rows; an empty table none. ``factor`` 1 is exact, and vectors then travel as they are;
    the default reaches a recall above 0.98 on this project's vectors. Only the two columns are read.

    Every vector goes to one shard of the top tree, fitted on ``sample`` vectors at most, those of the
    lowest hashes of their keys; shards above twice their size are salted into parts. Each shard
    answers its own vectors; those whose relaxed ball leaves the shard ask the other shards it
    touches. The questions to a part are sliced where they are many.
    """
    from lodestone.session import cut_lineage

    kind = EXACT if factor <= 1 else SHORT
    own = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where((F.size("v") == size) & F.col("id").isNotNull())
    total = own.count()
    picked = own.orderBy(F.xxhash64("id", F.lit(11))).limit(sample).toArrow()
    _, fitted = units_of(picked.column("v"), size)
    top = VantageTree(fitted, max(1, -(-len(fitted) * shard // max(total, 1)))) if len(fitted) else None
    shards = {number: i for i, number in enumerate(top.leaves())} if top else {0: 0}
    out = T.StructType([T.StructField("id", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("unit", T.BinaryType())])

    def homes(units: np.ndarray) -> pa.Array:
        return pa.array([shards[n] for n in top.homes(units).tolist()] if top else [0] * len(units), pa.int32())

    def route(batches):
        for batch in batches:
            rows, units = units_of(batch.column(1), size)
            if len(rows):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), homes(units), packed(units, kind)], names=out.fieldNames())

    def counted(batches):
        for batch in batches:
            numbers = homes(units_of(batch.column(1), size)[1]).value_counts()
            yield pa.RecordBatch.from_arrays([numbers.field(0), numbers.field(1)], names=["shard", "n"])

    def sums(rows: DataFrame) -> dict[int, int]:
        return {r["shard"]: r["n"] for r in rows.groupBy("shard").agg(F.sum("n").alias("n")).collect()}

    def of_shard(numbers: dict[int, int]):
        """A column: the number that ``numbers`` has for the shard (there are at most ``sample`` shards), else 1."""
        return F.get(F.from_json(F.lit(json.dumps([max(1, numbers.get(i, 1)) for i in range(len(shards))])), "array<int>"), F.col("shard"))

    routed = own.mapInArrow(route, out)
    parts = {s: -(-n // (2 * shard)) for s, n in sums(own.mapInArrow(counted, "shard int, n bigint")).items()}
    points = routed.withColumn("part", F.pmod(F.xxhash64("id"), of_shard(parts)).cast("int"))
    found = T.StructType([*out.fields, T.StructField("part", T.IntegerType()), T.StructField("kth", T.DoubleType()), T.StructField("targets", T.ArrayType(T.IntegerType())), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("scores", T.ArrayType(T.DoubleType()))])

    def groups(batches):
        """(shard, part, table) of each run of rows; a shard's points are few by construction."""
        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            code = np.stack([batch.column("shard").to_numpy(), batch.column("part").to_numpy()])
            cuts = [0, *(np.flatnonzero(np.any(code[:, 1:] != code[:, :-1], axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                now = (int(code[0, a]), int(code[1, a]))
                if held and held[0][0] != now:
                    yield held[0][0], pa.Table.from_batches([x for _, x in held])
                    held = []
                held.append((now, batch.slice(a, b - a)))
        if held:
            yield held[0][0], pa.Table.from_batches([x for _, x in held])

    def listed(best: Best, floor: np.ndarray) -> tuple[pa.Array, pa.Array]:
        good = (best.ids != np.iinfo(np.int64).max) & (best.scores > floor[:, None])
        ends = np.concatenate([[0], np.cumsum(good.sum(axis=1))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(best.ids[good])), pa.ListArray.from_arrays(pa.array(ends), pa.array(best.scores[good]))

    def at_home(batches):
        for (number, part), table in groups(batches):
            ids, units = table.column("id").to_numpy(), unpacked(table.column("unit"), size, kind)
            tree = VantageTree(units, LEAF)
            best = search(tree, ids[tree.order], units, ids, k, factor)
            kth = best.scores[:, -1]
            named = [(shards[leaf], rows) for leaf, rows in top.reached(units, relaxed_radius(kth, factor)) if shards[leaf] != number or parts[number] > 1] if top else []
            targets = grouped([rows for _, rows in named], [leaf for leaf, _ in named], len(ids), pa.int32())
            asking = pc.greater(pc.list_value_length(targets), 0)
            vectors = pc.if_else(asking, table.column("unit").combine_chunks(), pa.scalar(None, pa.binary()))
            lists = listed(best, np.full(len(ids), -2.0))
            whole = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), number, np.int32)), vectors, pa.array(np.full(len(ids), part, np.int32)), pa.array(kth), targets, *lists], names=found.fieldNames())
            for a in range(0, len(ids), 4096):
                yield whole.slice(a, 4096)

    first = cut_lineage(points.repartition("shard", "part").sortWithinPartitions("shard", "part").mapInArrow(at_home, found))
    slices = {s: -(-n // (SLICE * shard)) for s, n in sums(first.select(F.explode("targets").alias("shard"), F.lit(1).alias("n"))).items()}
    spread = T.StructType([T.StructField("id", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("scores", T.ArrayType(T.DoubleType()))])
    asked = first.select("id", "unit", "kth", F.col("shard").alias("home"), F.col("part").alias("home_part"), F.explode("targets").alias("shard"))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), of_shard(parts) - 1))).where("shard <> home or part <> home_part")
    asked = asked.select("shard", "part", F.pmod(F.xxhash64("id", F.lit(5)), of_shard(slices)).cast("int").alias("slice"), F.lit(1).alias("kind"), "id", "unit", "kth")
    held = points.select("shard", "part", F.explode(F.sequence(F.lit(0), of_shard(slices) - 1)).alias("slice"), F.lit(0).alias("kind"), "id", "unit", F.lit(None).cast("double").alias("kth"))

    def elsewhere(batches):
        tree, ids, now, gathered = None, None, None, []
        for batch in batches:
            code = np.stack([batch.column(c).to_numpy() for c in ("shard", "part", "slice", "kind")]) if batch.num_rows else np.zeros((4, 0))
            cuts = [0, *(np.flatnonzero(np.any(code[:, 1:] != code[:, :-1], axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if now != tuple(code[:3, a]):
                    now, gathered, tree = tuple(code[:3, a]), [], None
                if code[3, a] == 0:
                    gathered.append(part)
                    continue
                if tree is None:
                    if not gathered:
                        continue
                    stock = pa.Table.from_batches(gathered)
                    tree = VantageTree(unpacked(stock.column("unit"), size, kind), LEAF)
                    ids, gathered = stock.column("id").to_numpy()[tree.order], []
                kth = part.column("kth").to_numpy()
                asking = part.column("id").to_numpy()
                best = search(tree, ids, unpacked(part.column("unit"), size, kind), asking, k, factor, kth)
                lists = listed(best, kth)
                some = pa.array(np.diff(lists[0].offsets.to_numpy()) > 0)
                yield pa.RecordBatch.from_arrays([pa.array(asking), *lists], names=spread.fieldNames()).filter(some)

    second = held.unionByName(asked).repartition("shard", "part", "slice").sortWithinPartitions("shard", "part", "slice", "kind").mapInArrow(elsewhere, spread)
    every = first.select("id", "ids", "scores").unionByName(second).where(F.size("ids") > 0)
    each = every.select("id", F.explode(F.arrays_zip("scores", "ids")).alias("n"))
    ranked = each.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n.scores")).alias("s"), F.col("n.ids").alias("i")))), 1, k).alias("best"))
    return ranked.select(F.col("id").alias(key), F.explode("best").alias("b")).select(key, F.col("b.i").alias("neighbour"), (-F.col("b.s")).cast("double").alias("cosine"))


def neighbour_pairs(df: DataFrame, key: str, vector: str, size: int, k: int = 5, factor: float = 4.0) -> DataFrame:
    """(``key``_a, ``key``_b), a < b: the pairs of which one is among the ``k`` nearest of the other, each once."""
    near = nearest(df, key, vector, size, k, factor)
    return near.select(F.least(key, "neighbour").alias(f"{key}_a"), F.greatest(key, "neighbour").alias(f"{key}_b")).distinct()

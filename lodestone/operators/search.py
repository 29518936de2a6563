"""Filtered exact search, enrichment of hits, resolution of references."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lodestone.functions import text as X

POINT_TYPES = ("rag_chunk", "table_record", "evidence_record")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of one size; 0 if either has no length."""
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(add(F.transform(a, lambda v: v * v))) * F.sqrt(add(F.transform(b, lambda v: v * v)))
    return F.when(norms > 0, add(F.zip_with(a, b, lambda x, y: x * y)) / norms).otherwise(0.0)


def search(points: DataFrame, vector: list[float], limit: int = 8, point_type: str | None = None, usable_only: bool = True) -> DataFrame:
    """The ``limit`` points most similar to ``vector`` with their score, ties by payload_key; exact.

    The filters stand before the scores, so they reach the scan. Points without a vector of the
    query's size are left out; a limit under 1, an unknown type and an empty vector are errors.
    """
    if limit < 1 or not vector or point_type not in (None, *POINT_TYPES):
        raise ValueError("limit, vector or point type")
    found = points
    if point_type:
        found = found.where(F.col("point_type") == point_type)
    if usable_only:
        found = found.where("usable_for_ranking")
    query = F.array(*[F.lit(float(x)) for x in vector])
    scored = found.where(F.size("vector") == len(vector)).withColumn("score", cosine(F.col("vector"), query)).drop("vector")
    return scored.orderBy(F.col("score").desc(), "payload_key").limit(limit)


def enrich(hits: DataFrame, chunks: DataFrame, tables: DataFrame, out: str = "source_chunk_text") -> DataFrame:
    """``hits`` (document_id, source_id, parent_source_id) with ``out``: the text of their parent source, else of their own.

    Sources are found by document and id: ``chunks`` (document_id, chunk_id, text) and ``tables``
    (document_id, table_id, text), each id once in its document; a table goes before a chunk of the
    same id. A text that a hit brings along is kept; without any source it stays null.
    """
    source = lambda df, key, rank: df.select(F.col("document_id").alias("_d"), F.col(key).alias("_id"), F.struct(F.lit(rank).alias("rank"), F.col("text").alias("text")).alias("_t"))
    texts = source(chunks, "chunk_id", 0).unionByName(source(tables, "table_id", 1)).where("_id IS NOT NULL").groupBy("_d", "_id").agg(F.max("_t").alias("_t"))
    wanted = hits.withColumn("_key", F.coalesce(F.nullif("parent_source_id", F.lit("")), "source_id"))
    found = wanted.join(texts, (F.col("document_id") == F.col("_d")) & (F.col("_key") == F.col("_id")), "left")
    kept = F.coalesce(F.nullif(F.col(out), F.lit("")), F.col("_t.text")) if out in hits.columns else F.col("_t.text")
    return found.withColumn(out, kept).drop("_d", "_id", "_t", "_key")


def resolve(refs: DataFrame, hits: DataFrame) -> DataFrame:
    """(group_id, ord, ref, source_id, citation) of the references that a hit of their group answers.

    ``refs``: group_id, ord, ref; ``hits``: group_id, rank, source_id, citation. A reference is a
    source id, else a citation, else a rank from 1; of several hits the last by rank answers. Others
    are dropped: nothing invented survives. References are trimmed, blank and null ones dropped.
    """
    plain = refs.withColumn("ref", X.strip(F.col("ref"))).where("ref <> ''")
    last = lambda by: hits.where(F.col(by).isNotNull()).groupBy("group_id", F.col(by).cast("string").alias("ref")).agg(F.max_by(F.struct("source_id", "citation"), "rank").alias("h"))
    named = last("source_id").select("group_id", "ref", F.lit(0).alias("p"), "h").unionByName(last("citation").select("group_id", "ref", F.lit(1).alias("p"), "h")).unionByName(last("rank").select("group_id", "ref", F.lit(2).alias("p"), "h"))
    best = named.groupBy("group_id", "ref").agg(F.min_by("h", "p").alias("h"))
    return plain.join(best, ["group_id", "ref"]).select("group_id", "ord", "ref", "h.source_id", "h.citation")


def elements(answers: DataFrame, column: str, path: str | None, allowed) -> DataFrame:
    """(group_id, pos, v): the objects of the JSON list in ``column`` (or in its member ``path``) as variants, but those with a key not in ``allowed``.

    A single object stands for a list of one where no ``path`` is given.
    """
    text = F.col(column) if path is None else F.get_json_object(column, f"$.{path}")
    text = F.when(X.strip(text).startswith("["), text).when(X.strip(text).startswith("{") & F.lit(path is None), F.concat(F.lit("["), text, F.lit("]")))
    each = answers.select("group_id", F.posexplode(F.from_json(text, "array<string>")).alias("pos", "e")).where(F.col("e").startswith("{"))
    keys = F.json_object_keys("e")
    return each.where(F.size(F.array_except(keys, F.array(*[F.lit(k) for k in allowed]))) == 0).select("group_id", "pos", F.try_parse_json("e").alias("v"))


def kind_of(name: str) -> Column:
    """The kind of a member of the variant ``v``, null if it is not there."""
    return F.schema_of_variant(F.try_variant_get("v", f"$.{name}", "variant"))


def text_of(name: str) -> Column:
    return F.try_variant_get("v", f"$.{name}", "string")


def confidence_of() -> Column:
    """The confidence given, medium if it is none of the known ones."""
    return F.when(text_of("confidence").isin("low", "medium", "high"), text_of("confidence")).otherwise("medium")


def resolved(each: DataFrame, hits: DataFrame) -> DataFrame:
    """The rows of :func:`elements` of which some reference is one of the group's ``hits``, with evidence_ids and citations, each once, in order."""
    refs = lambda name: F.coalesce(F.try_variant_get("v", f"$.{name}", "array<string>"), F.array().cast("array<string>"))
    named = each.select("group_id", "pos", F.posexplode(F.concat(refs("evidence_ids"), refs("citations"))).alias("i", "ref")).withColumn("ord", F.struct("pos", "i"))
    found = resolve(named.select("group_id", "ord", "ref"), hits)
    kept = found.groupBy("group_id", F.col("ord.pos").alias("pos")).agg(F.array_sort(F.collect_list(F.struct(F.col("ord.i").alias("i"), "source_id", "citation"))).alias("r"))
    once = lambda part: F.array_distinct(F.array_compact(F.transform("r", lambda x: F.nullif(x[part], F.lit("")))))
    return each.join(kept, ["group_id", "pos"]).withColumns({"evidence_ids": once("source_id"), "citations": once("citation")})


def top_per_group(df: DataFrame, group: list[str], order: list, limit: int) -> DataFrame:
    """The first ``limit`` rows of each group with their rank from 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= limit)


def shown(column: Column) -> Column:
    """JSON as a generator is shown it: with single quotes, True, False and None; ``{}`` for null."""

    @F.pandas_udf("string")
    def written(values: pd.Series) -> pd.Series:
        return values.map(lambda x: repr(json.loads(x)) if x else "{}")

    return F.when(F.coalesce(column, F.lit("{}")).isin("{}", "[]"), F.coalesce(column, F.lit("{}"))).otherwise(written(column))


def context_head(place: Column) -> Column:
    """The first two lines of a hit in the context: place, score, types; source, citation, usability, flags."""
    yes = lambda c: F.when(F.coalesce(c, F.lit(False)), "True").otherwise("False")
    flags = F.array_join(F.transform(F.coalesce("quality_flags", F.array().cast("array<string>")), lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", ")
    dash = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("-"))
    first = F.format_string("[%d] score=%.4f type=%s record_type=%s", place, F.col("score"), F.coalesce("point_type", F.lit("")), dash("record_type"))
    return F.concat(first, F.lit("\n"), F.format_string("source_id=%s citation=%s usable=%s flags=[%s]", F.coalesce("source_id", F.lit("")), dash("citation"), yes(F.col("usable_for_ranking")), flags))


def context(hits: DataFrame, group: str, width: int = 900) -> DataFrame:
    """(group, context): the hits of a group (a bounded top-k) as numbered blocks in rank order, five lines each, the text cut at ``width``.

    ``hits``: group, hit_rank, score, point_type, record_type, source_id, citation, usable_for_ranking,
    quality_flags, extracted (JSON), metrics, text. Nulls show as a dash, an empty list or nothing.
    """
    placed = hits.withColumn("_at", F.row_number().over(Window.partitionBy(group).orderBy("hit_rank")))
    metrics = shown(F.to_json(F.coalesce("metrics", F.array().cast(hits.schema["metrics"].dataType))))
    block = F.concat_ws("\n", context_head(F.col("_at")), F.concat(F.lit("extracted="), shown(F.col("extracted"))), F.concat(F.lit("metrics="), metrics), F.concat(F.lit("text="), F.substring(F.coalesce("text", F.lit("")), 1, width)))
    each = placed.select(group, "_at", block.alias("block"))
    return each.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "block"))), lambda b: b["block"]), "\n\n").alias("context"))


def retrieve(points: DataFrame, queries: DataFrame, key: str, text: str, embedder, limit: int = 8, point_type: str | None = None, usable_only: bool = True) -> DataFrame:
    """(``key``, rank, score, and the payload of the point): the ``limit`` most similar points of each query text, exact.

    ``points``: id and vector of the embedder's size, with their payload; ``queries``: each key once.
    The filters reach the scan; equal texts are asked once; queries whose text gives no features find
    nothing.
    """
    if limit < 1 or point_type not in (None, *POINT_TYPES):
        raise ValueError("limit or point type")
    kept = points.where(F.col("point_type") == point_type) if point_type else points
    kept = kept.where("usable_for_ranking") if usable_only else kept
    texts = queries.select(F.col(key), F.col(text).alias("_text")).where("_text IS NOT NULL")
    firsts = texts.groupBy("_text").agg(F.min(key).alias("_first"), F.max("_text").alias("_said"))  # _said: filters on vectors of the group's key would move before the grouping
    found = search_many(kept.select("id", "vector"), firsts.select("_first", embedder.embed(F.col("_said")).alias("vector")), "id", "vector", embedder.dimensions, limit, query_key="_first")
    ranked = top_per_group(found, ["query"], [F.col("score").desc(), "id"], limit)
    asked = texts.join(firsts, "_text").select(key, "_first")
    return asked.join(ranked, F.col("_first").eqNullSafe(F.col("query"))).select(key, "id", "score", "rank").join(kept.drop("vector"), "id")


class _Chunk:
    """Points of one chunk, in order of their ids, of which any query finds the ``k`` most similar.

    Scores are found in 32-bit numbers, a tile of points at a time. Those that may reach the k best so
    far, whatever the rounding, are computed again in 64-bit numbers, each alone, so that equal vectors
    score alike wherever they stand. Of equal vectors only the first k are kept.
    """

    TILE = 2048

    def __init__(self, ids: pa.Array, units: np.ndarray, k: int, own: bool):
        order = pc.sort_indices(ids).to_numpy()
        seen: dict[bytes, int] = {}
        kept = []
        for i in order.tolist():
            row = units[i].tobytes()
            if (n := seen.get(row, 0)) < k + own:
                seen[row] = n + 1
                kept.append(i)
        self.ids, self.units, self.k, self.own = ids.take(pa.array(kept, pa.int64())), units[kept], k, own
        self.small = self.units.astype(np.float32)
        self.slack = (units.shape[1] + 8) * 2.0**-23

    def _exact(self, vectors: np.ndarray, who: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.empty(len(at))
        for c in range(0, len(at), 65_536):
            some = slice(c, c + 65_536)
            out[some] = (vectors[who[some]] * self.units[at[some]]).sum(axis=1)
        return out

    def best(self, names: pa.Array, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, place of the point, score) by query, score and place."""
        k, small, numbers = self.k, vectors.astype(np.float32), np.arange(len(vectors))
        bound = np.full(len(vectors), -np.inf)
        who, at, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for begin in range(0, len(self.units), self.TILE):
            scores = small @ self.small[begin : begin + self.TILE].T
            width = 16 * (k + self.own)
            if begin == 0 and (whole := scores.shape[1] // width * width):  # k groups of points hold k points
                most = scores[:, :whole].reshape(len(vectors), -1, width).max(axis=1)
                bound = np.partition(most, width - k - self.own, axis=1)[:, width - k - self.own].astype(float) - self.slack
            more = np.flatnonzero(scores >= (bound - self.slack).astype(np.float32)[:, None])
            if not len(more):
                continue
            q, p = np.divmod(more, scores.shape[1])
            p += begin
            if self.own:
                other = ~pc.fill_null(pc.equal(names.take(pa.array(q)), self.ids.take(pa.array(p))), False).to_numpy(zero_copy_only=False)
                q, p = q[other], p[other]
            who, at, score = np.concatenate([who, q]), np.concatenate([at, p]), np.concatenate([score, self._exact(vectors, q, p)])
            order = np.lexsort((at, -score, who))
            who, at, score = who[order], at[order], score[order]
            first = np.searchsorted(who, numbers)
            good = np.arange(len(who)) - first[who] < k
            full = np.searchsorted(who, numbers, "right") - first >= k
            bound[full] = score[first[full] + k - 1]
            who, at, score = who[good], at[good], score[good]
        return who, at, score


def search_many(points: DataFrame, queries: DataFrame, key: str, vector: str, size: int, k: int = 5, chunk: int = 50_000, query_key: str | None = None) -> DataFrame:
    """(query, ``key``, score): the ``k`` most similar points of each query, exact.

    Points have ``key`` and ``vector``; queries the same, and then don't find their own key, or
    ``query_key`` and ``vector``. Vectors that aren't ``size`` numbers or have no length are left out.
    The points are cut into chunks of about ``chunk`` by a hash of their key, a task each; every query
    is sent to every chunk, whose task keeps its points and streams the queries in blocks, so only k
    candidates a query and chunk leave it. Ties go to the lower key.
    """
    own = query_key is None
    name = query_key or key
    kinds = {"point": points.schema[key].dataType, "query": queries.schema[name].dataType}
    usable = lambda df, column: df.select(F.col(column).alias("id"), F.col(vector).cast("array<double>").alias("v")).where((F.size("v") == size) & F.exists("v", lambda x: x != 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    parts = max(1, -(-points.count() // chunk))
    nothing = {side: F.lit(None).cast(kind) for side, kind in kinds.items()}
    held = usable(points, key).select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("kind"), F.col("id").alias("point"), nothing["query"].alias("query"), "v")
    asked = usable(queries, name).select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("kind"), nothing["point"].alias("point"), F.col("id").alias("query"), "v")
    out = T.StructType([T.StructField("query", kinds["query"]), T.StructField("id", kinds["point"]), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(out)
    def unit(column):
        matrix = column.flatten().to_numpy().reshape(-1, size)
        return matrix / np.linalg.norm(matrix, axis=1)[:, None]

    def work(batches):
        now, held, stock = None, None, []
        for batch in batches:
            part, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((part[1:] != part[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                rows = batch.slice(a, b - a)
                if part[a] != now:
                    now, held, stock = part[a], None, []
                if kind[a] == 0:
                    stock.append(rows)
                    continue
                if held is None:
                    if not stock:
                        continue
                    held, stock = _Chunk(pa.concat_arrays([x.column(2) for x in stock]), np.concatenate([unit(x.column(4)) for x in stock]), k, own), []
                who, vectors = rows.column(3), unit(rows.column(4))
                for c in range(0, len(who), 256):
                    some = who.slice(c, 256)
                    q, p, score = held.best(some, vectors[c : c + 256])
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) if isinstance(x, np.ndarray) else x.cast(f.type) for x, f in zip((some.take(pa.array(q)), held.ids.take(pa.array(p)), score), arrow)], schema=arrow)

    found = held.unionByName(asked).repartitionById(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(work, out)
    return top_per_group(found, ["query"], [F.col("score").desc(), "id"], k).select("query", F.col("id").alias(key), "score")

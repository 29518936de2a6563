"""Groups of records that share most of their words.

Exact copies are folded first. Candidate pairs share a bucket: a band of one sample over their rarest
words, taken to the limit of all samples, which are these words themselves and miss no pair; or,
where such words are in too many sets, a band of several MinHash samples. Odd sketches (the parity
bitmap of the MinHash samples of the whole set) discard most candidates inside the join by the
population count of their XOR, and the sets themselves decide the rest.
"""

from __future__ import annotations

import json
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.session import cut_lineage

WORD = re.compile(r"[^\W_]+")
#: MinHash samples folded into a sketch, and its bits.
SAMPLES, BITS = 128, 256
#: A word is hot if it is in more sets than this (and than LOADS times the mean load of the count table's slots). So many comparisons
#: of sketches cost about what the 64 bands do that a set needs beside hot words: 384 samples of all its words and 3 KB to be moved.
HOT, LOADS = 2048, 4
#: Slots of the table of word counts: so many that the mean load is LOAD, but between these powers of two (four bytes each, so 16 MB at most).
LOAD, SLOTS = 32, (16, 22)
#: Bands x samples over the hot words of sets that need them, and bits of the bitmap of the poor sets' bands (8 MB).
HOT_BANDS, BITMAP = (64, 6), 1 << 26
#: A row of a rare word carries its set's size times this, plus the number of hot words in the set's prefix; a row of a band carries -1.
INFO = 1 << 20
_MULTIPLY = np.random.default_rng(20).integers(1, 2**63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_set(text: str) -> set[str]:
    """The distinct words of ``text``: maximal runs of letters or digits, lower-cased."""
    return set(WORD.findall(text.lower()))


def string_values(text: str) -> str:
    """All string values of a JSON text at any depth, not the keys; empty if it is no JSON."""
    try:
        pending, found = [json.loads(text)], []
    except ValueError:
        return ""
    while pending:
        value = pending.pop()
        if isinstance(value, str):
            found.append(value)
        elif isinstance(value, (list, dict)):
            pending.extend(value.values() if isinstance(value, dict) else value)
    return "\n".join(found)


def _mixed(values: np.ndarray, number: int) -> np.ndarray:
    """A random function of 64-bit ``values``, by ``number``."""
    x = values * _MULTIPLY[number % 1024]
    x ^= x >> np.uint64(29)
    x *= _MULTIPLY[(number * 7 + 3) % 1024]
    return x ^ (x >> np.uint64(32))


def _minima(words: np.ndarray, starts: np.ndarray, first: int, count: int) -> np.ndarray:
    """``count`` MinHash samples (count x sets) of the non-empty sets that begin at ``starts``."""
    return np.stack([np.minimum.reduceat(_mixed(words, first + i), starts) for i in range(count)]) if len(starts) else np.zeros((count, 0), np.uint64)


def odd_sketches(minima: np.ndarray) -> np.ndarray:
    """(sets x BITS/64) parity bitmaps of MinHash samples."""
    sketch = np.zeros((minima.shape[1], BITS // 64), np.uint64)
    rows = np.arange(minima.shape[1])
    for i, sample in enumerate(minima):
        bit = (_mixed(sample, 600 + i) >> np.uint64(20)) % np.uint64(BITS)
        sketch[rows, (bit // np.uint64(64)).astype(np.int64)] ^= np.uint64(1) << (bit % np.uint64(64))
    return sketch


def sketch_similarity(differing: float) -> float:
    """The similarity that ``differing`` bits between two odd sketches estimate."""
    return 1.0 if differing <= 0 else max(0.0, 1 + BITS / (4 * SAMPLES) * math.log(max(1 - 2 * differing / BITS, 1e-9)))


def differing_limit(threshold: float, deviations: float = 4.5) -> int:
    """Bits that two sets of similarity ``threshold`` differ in at most, but for ``deviations`` standard deviations."""
    flips = 2 * SAMPLES * (1 - threshold)
    keep = math.exp(-2 * flips / BITS)
    spread = math.sqrt(BITS * (1 - keep**2) / 4 + (keep * 2 * math.sqrt(SAMPLES * threshold * (1 - threshold))) ** 2)
    return min(BITS, math.ceil(BITS / 2 * (1 - keep) + deviations * spread))


def _bands(minima: np.ndarray, bands: int, rows: int, field: int) -> np.ndarray:
    """(bands x sets) hashes of the bands of ``rows`` samples."""
    out = np.empty((bands, minima.shape[1]), np.uint64)
    for band in range(bands):
        value = np.full(minima.shape[1], np.uint64(field * 1000 + band + 1))
        for sample in minima[band * rows : (band + 1) * rows]:
            value = _mixed(value ^ sample, 900)
        out[band] = value
    return out


def fold_copies(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``items`` (field, id, text, is_json) as (members: field, id, rid) and (sets: rid, field, words), one set a distinct content.

    Texts without words and nulls belong to no set. An id with several different texts is a member of each one's set.
    """
    import xxhash

    own = items.select("field", F.col("id").cast("string").alias("id"), "text", "is_json").where(F.col("text").isNotNull())
    made = T.StructType([T.StructField("field", T.StringType()), T.StructField("id", T.StringType()), T.StructField("sig", T.BinaryType()), T.StructField("words", T.ArrayType(T.LongType()))])

    def work(batches):
        known: dict[str, int] = {}
        digest, digest128 = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_digest
        for batch in batches:
            fields, ids, sigs, flat, ends = [], [], [], [], [0]
            for field, key, text, is_json in zip(*(c.to_pylist() for c in batch.columns)):
                words = word_set(string_values(text) if is_json else text)
                if not words:
                    continue
                if len(known) > 300_000:
                    known.clear()
                hashes = []
                for word in words:
                    value = known.get(word)
                    if value is None:
                        value = known[word] = digest(word)
                    hashes.append(value)
                array = np.sort(np.array(hashes, np.uint64))
                fields.append(field)
                ids.append(key)
                sigs.append(digest128(array.tobytes()))
                flat.append(array)
                ends.append(ends[-1] + len(array))
            if ids:
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(fields), pa.array(ids), pa.array(sigs, pa.binary()), lists], names=made.fieldNames())

    rows = own.mapInArrow(work, made)
    folded = rows.groupBy("field", "sig").agg(F.first("words").alias("words"), F.min("id").alias("first_id"))
    sets = cut_lineage(folded.select(F.monotonically_increasing_id().alias("rid"), "field", "sig", "words", "first_id"))
    alone = sets.select("rid", "field", "sig")
    members = rows.select("field", "id", "sig").distinct().join(alone, ["field", "sig"]).select("field", "id", "rid")
    return members, sets.select("rid", "field", "words")


def _slots(words: np.ndarray, field: int, slots: int) -> np.ndarray:
    return (_mixed(words ^ np.uint64(field + 1), 902) >> np.uint64(8)) % np.uint64(slots)


def _word_counts(sets: DataFrame, fields: list[str]) -> tuple[np.ndarray, int]:
    """(counts by slot, least count of a hot word): in how many sets the words of a slot are. A word counts its slot's total, never less than its own."""
    total = sets.agg(F.sum(F.size("words"))).collect()[0][0] or 0
    slots = 1 << min(max(SLOTS[0], math.ceil(math.log2(max(total / LOAD, 1)))), SLOTS[1])

    def work(batches):
        counts = np.zeros(slots, np.int64)
        for batch in batches:
            names, lists = np.array(batch.column(0).to_pylist()), batch.column(1)
            words, sizes = lists.flatten().to_numpy().view(np.uint64), np.diff(lists.offsets.to_numpy())
            for number, field in enumerate(fields):
                counts += np.bincount(_slots(words[np.repeat(names == field, sizes)], number, slots).astype(np.int64), minlength=slots)
        used = np.flatnonzero(counts)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["slot", "n"])

    rows = sets.select("field", "words").mapInArrow(work, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(slots, np.uint32)
    table[rows.column("slot").to_numpy()] = np.minimum(rows.column("n").to_numpy(), 2**32 - 1)
    return table, max(HOT, LOADS * total // slots)


class _Sets:
    """Some sets of one field: their words from the rarest on, and what they need to meet their partners.

    The rarest word that two sets of the threshold share is among the first ``size - threshold * size
    + 1`` of either (the prefix). If it is not hot, both are in its bucket. If it is, they share hot
    words only, so all others lie outside; of such a pair at least one set is poor: it has at most
    (1 - threshold) / (1 + threshold) of its words that are not hot.
    """

    def __init__(self, words: np.ndarray, sizes: np.ndarray, field: int, table: np.ndarray, hot: int, threshold: float):
        owner = np.repeat(np.arange(len(sizes)), sizes)
        counts = table[_slots(words, field, len(table)).astype(np.int64)]
        order = np.lexsort((words, counts, owner))
        self.words, self.owner, self.field = words[order], owner, field
        self.starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        is_hot = counts[order] > hot
        prefix = sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1
        leading = np.arange(len(words)) - self.starts[owner] < prefix[owner]
        self.rare_leading, self.is_hot = leading & ~is_hot, is_hot
        hot_leading = np.bincount(owner[leading & is_hot], minlength=len(sizes))
        self.needs_bands, self.info = hot_leading > 0, sizes * INFO + np.minimum(hot_leading, INFO - 1)
        self.poor = np.bincount(owner[~is_hot], minlength=len(sizes)) <= (1 - threshold) / (1 + threshold) * sizes + 1e-9

    def buckets(self) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, set) for the rare words of the prefixes."""
        return _mixed(self.words[self.rare_leading] ^ np.uint64(self.field + 1), 901), self.owner[self.rare_leading]

    def bands(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, set) for the bands over the hot words of the ``chosen`` sets, band by band."""
        kept = self.is_hot & chosen[self.owner]
        sizes = np.bincount(self.owner[kept], minlength=len(chosen))[chosen]
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        bands, rows = HOT_BANDS
        return _bands(_minima(self.words[kept], starts, 300, bands * rows), bands, rows, self.field).reshape(-1), np.tile(np.flatnonzero(chosen), bands)


def similar_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """(rid_a, rid_b): the pairs of different ``sets`` of one field whose shared words are at least ``threshold`` of all their words.

    Candidates share a bucket: a rare word of both prefixes (exact), or, where the shared words are
    all hot, a band of MinHash samples of the hot words. Of the latter pairs one set is poor
    (:class:`_Sets`), so the others send only the bands that some poor set has, by a bitmap of fixed
    size. Buckets of rare words hold at most the least count of a hot word. Candidates with fewer rare
    words in common than the threshold needs of the prefixes are left out before the sets are compared.
    """
    context = sets.sparkSession.sparkContext
    fields = sorted(r["field"] for r in sets.select("field").distinct().collect())
    table, hot = _word_counts(sets, fields)
    counts = context.broadcast(table)
    kind = T.StructType([T.StructField("band", T.LongType()), T.StructField("rid", T.LongType()), T.StructField("info", T.LongType()), *[T.StructField(f"s{i}", T.LongType()) for i in range(BITS // 64)]])

    def parts(batches):
        """(rids, sets, words, starts) of the sets of one field, some at a time."""
        for whole in batches:
            for a in range(0, whole.num_rows, 2000):
                batch = whole.slice(a, 2000)
                rids, names, lists = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist()), batch.column(2)
                for number, field in enumerate(fields):
                    mine = np.flatnonzero(names == field)
                    if len(mine):
                        picked = lists.take(pa.array(mine))
                        words, sizes = picked.flatten().to_numpy().view(np.uint64), np.diff(picked.offsets.to_numpy()).astype(np.int64)
                        yield rids[mine], _Sets(words, sizes, number, counts.value, hot, threshold), words, np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)

    def mark(batches):
        bits = np.zeros(BITMAP // 64, np.uint64)
        for _, some, _, _ in parts(batches):
            chosen = some.needs_bands & some.poor
            if chosen.any():
                at = some.bands(chosen)[0] % np.uint64(BITMAP)
                np.bitwise_or.at(bits, (at // np.uint64(64)).astype(np.int64), np.uint64(1) << (at % np.uint64(64)))
        used = np.flatnonzero(bits)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(bits[used].view(np.int64))], names=["at", "bits"])

    own = sets.select("rid", "field", "words")
    marks = own.mapInArrow(mark, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    bitmap = np.zeros(BITMAP // 64, np.uint64)
    bitmap[marks.column("at").to_numpy()] = marks.column("bits").to_numpy().view(np.uint64)
    poor_bands = context.broadcast(bitmap if marks.num_rows else None)

    def work(batches):
        there = poor_bands.value
        for rids, some, words, starts in parts(batches):
            sketch = odd_sketches(_minima(words, starts, 0, SAMPLES))
            found = [(*(rare := some.buckets()), some.info[rare[1]])]
            if there is not None:
                if (poor := some.needs_bands & some.poor).any():
                    found.append((*(all_bands := some.bands(poor)), np.full(len(all_bands[0]), -1)))
                if (rest := some.needs_bands & ~some.poor).any():
                    bands, at = some.bands(rest)
                    slot = bands % np.uint64(BITMAP)
                    met = (there[(slot // np.uint64(64)).astype(np.int64)] >> (slot % np.uint64(64))) & np.uint64(1) > 0
                    found.append((bands[met], at[met], np.full(int(met.sum()), -1)))
            bands, at, info = (np.concatenate(x) for x in zip(*found))
            columns = [bands.view(np.int64), rids[at], info.astype(np.int64), *[np.ascontiguousarray(sketch[at, i]).view(np.int64) for i in range(sketch.shape[1])]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=kind.fieldNames())

    banded = own.mapInArrow(work, kind)
    differing = None
    for i in range(BITS // 64):
        bits = F.bit_count(F.col(f"a.s{i}").bitwiseXOR(F.col(f"b.s{i}")))
        differing = bits if differing is None else differing + bits
    near = (F.col("a.band") == F.col("b.band")) & (F.col("a.rid") < F.col("b.rid")) & (differing <= differing_limit(threshold))
    met = banded.alias("a").join(banded.alias("b").hint("merge"), near).select(F.col("a.rid").alias("rid_a"), F.col("b.rid").alias("rid_b"), F.col("a.info").alias("ia"), F.col("b.info").alias("ib"))
    pairs = met.groupBy("rid_a", "rid_b").agg(F.count_if(F.col("ia") >= 0).alias("rare"), (F.min("ia") < 0).alias("banded"), F.max("ia").alias("ia"), F.max("ib").alias("ib"))
    # Up to where the earlier prefix ends, shared words are in both prefixes: rare ones, which were counted, and hot ones; the rest lies beyond.
    size = lambda c: F.floor(F.col(c) / INFO)
    beyond = lambda c: F.ceil(threshold * size(c) - 1e-9) - 1
    most = F.col("rare") + F.least(F.pmod(F.col("ia"), F.lit(INFO)), F.pmod(F.col("ib"), F.lit(INFO))) + F.greatest(beyond("ia"), beyond("ib"))
    candidates = pairs.where(F.col("banded") | (most >= F.ceil(threshold / (1 + threshold) * (size("ia") + size("ib")) - 1e-9))).select("rid_a", "rid_b")
    words = sets.select("rid", "words")
    both = candidates.join(words.withColumnsRenamed({"rid": "rid_a", "words": "wa"}), "rid_a").join(words.withColumnsRenamed({"rid": "rid_b", "words": "wb"}), "rid_b")
    shared = F.size(F.array_intersect("wa", "wb"))
    return both.where(shared >= threshold * (F.size("wa") + F.size("wb") - shared) - 1e-9).select("rid_a", "rid_b")


def near_duplicate_pairs(items: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(field_name, key_a, key_b), key_a < key_b: the pairs of different ids of one field that share ``threshold`` of all their words.

    ``items``: field, id, text, is_json (then the words are those of the string values). Null texts,
    texts without words and texts that are no JSON where it is expected pair with nothing; repeated
    rows count once; an id with several texts is as similar as its most similar one. Other columns
    are ignored, an empty table gives no rows.
    """
    members, sets = fold_copies(items)
    members = cut_lineage(members)
    links = similar_sets(sets, threshold)
    a, b = members.select("field", F.col("id").alias("x"), F.col("rid").alias("rid_a")), members.select(F.col("id").alias("y"), F.col("rid").alias("rid_b"))
    across = links.join(a, "rid_a").join(b, "rid_b").where("x <> y")
    within = a.join(b, (F.col("rid_a") == F.col("rid_b")) & (F.col("x") < F.col("y")))
    pairs = across.select("field", "x", "y").unionByName(within.select("field", "x", "y"))
    return pairs.select(F.col("field").alias("field_name"), F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(rid, root): the least rid connected to each of ``nodes`` by ``links`` (rid_a, rid_b).

    Labels shrink to the least label of the neighbours, and to the label of the label; the number of
    rounds grows with the logarithm of the longest chain. Every round is written to the shared folder.
    """
    edges = cut_lineage(links.select(F.col("rid_a").alias("u"), F.col("rid_b").alias("v")).unionByName(links.select(F.col("rid_b").alias("u"), F.col("rid_a").alias("v"))))
    labels = cut_lineage(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("root")).withColumnRenamed("u", "rid"))
    while True:
        reach = edges.join(labels.select(F.col("rid").alias("v"), F.col("root").alias("via")), "v").groupBy("u").agg(F.min("via").alias("via")).withColumnRenamed("u", "rid")
        lower = labels.join(reach, "rid").select("rid", F.col("root").alias("old"), F.least("root", "via").alias("mid"))
        jump = labels.select(F.col("rid").alias("mid"), F.col("root").alias("beyond"))
        moved = cut_lineage(lower.join(jump, "mid", "left").select("rid", "old", F.least("mid", F.coalesce("beyond", "mid")).alias("root")))
        changed = moved.where("root <> old").limit(1).count()
        labels = moved.select("rid", "root")
        if not changed:
            return nodes.select("rid").distinct().join(labels, "rid", "left").select("rid", F.coalesce("root", "rid").alias("root"))


def near_duplicate_groups(items: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(field_name, id, group_id, n_links): each id with its group, the least id that links of :func:`near_duplicate_pairs` connect it to.

    ``n_links`` counts the other texts (copies once) that its own text is linked to; ids without any
    link are groups of one. Same handling of nulls and repeated rows.
    """
    members, sets = fold_copies(items)
    members = cut_lineage(members)
    links = cut_lineage(similar_sets(sets, threshold))
    degree = links.select(F.col("rid_a").alias("rid")).unionByName(links.select(F.col("rid_b").alias("rid"))).groupBy("rid").count()
    roots = components(sets, links)
    placed = members.join(roots, "rid").join(degree, "rid", "left")
    names = placed.groupBy("root").agg(F.min("id").alias("group_id"))
    each = placed.join(names, "root").groupBy(F.col("field").alias("field_name"), "id").agg(F.min("group_id").alias("group_id"), F.sum(F.coalesce("count", F.lit(0))).alias("n_links"))
    return each

"""From blocks to chunks: routing, section carry-forward, greedy packing, merging of short chunks.

The layout (which block belongs to which chunk) is found on narrow rows: keys, lengths, pages,
titles. Texts join it once, at the end. Nothing sequential runs over a whole document: documents are
cut into buckets of their order, each bucket is summed up as a function of what comes in, the
functions are composed, and the buckets are then worked through side by side.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import signals as S
from lodestone.functions import text as X
from lodestone.operators.prefix import BUCKET, bucket_of, carry_last, running, with_carried
from lodestone.session import cut_lineage

# How the kinds of blocks are treated, and the sizes of a chunk in characters.
SKIPPED, TEXTUAL = ("header", "footer", "page_number"), ("text", "list", "equation")
LIMIT, LEAST = 1200, 80


def routed(kind: Column, text: Column) -> Column:
    """Where a block goes: skip, text (if not blank), table or other."""
    return F.when(kind.isin(*SKIPPED), "skip").when(kind.isin(*TEXTUAL), F.when(F.coalesce(X.strip(text), F.lit("")) != "", "text").otherwise("other")).when(kind == "table", "table").otherwise("other")


def section_title(level: Column, text: Column) -> Column:
    """The block's text if it is a title (it has a level, or is numbered with a dot at the end), else null."""
    return F.when((F.coalesce(text, F.lit("")) != "") & (level.isNotNull() | text.rlike(r"^\d+(?:\.\d+)*\.\s+\S+")), text)


def with_sections(blocks: DataFrame, title: Column, out: str = "section") -> DataFrame:
    """``blocks`` with the last title up to each block of its document. Headers, footers and page numbers tell no title and are left out before."""
    return carry_last(blocks, ["document_id"], "block_index", title, out)


def _sectioned(rows: DataFrame, bucket: int) -> DataFrame:
    """``rows`` (document_id, block_index, route, title, page) with _bucket, section, and, for texts, whether the block must start a chunk."""
    keyed = rows.select("*", bucket_of("block_index", bucket))
    own = Window.partitionBy("document_id", "_bucket").orderBy("block_index")
    local = keyed.withColumn("_local", F.last("title", True).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    sums = local.groupBy("document_id", "_bucket").agg(F.max_by("_local", "block_index").alias("_title"), F.max_by(F.struct("_local", "page"), F.when(F.col("route") == "text", F.col("block_index"))).alias("_text"))
    earlier = Window.partitionBy("document_id").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    came = sums.withColumn("_section_in", F.last("_title", True).over(earlier))
    last_text = F.when(F.col("_text").isNotNull(), F.struct(F.coalesce("_text._local", "_section_in").alias("section"), F.col("_text.page").alias("page")))
    came = came.withColumn("_text_in", F.last(last_text, True).over(earlier)).select("document_id", "_bucket", "_section_in", "_text_in")
    placed = with_carried(local, came, ["document_id"]).withColumn("section", F.coalesce("_local", "_section_in"))
    texts = Window.partitionBy("document_id", "_bucket", "route").orderBy("block_index")
    before = F.coalesce(F.lag(F.struct("section", "page")).over(texts), F.col("_text_in"))
    start = before.isNull() | ~before["section"].eqNullSafe(F.col("section")) | (F.col("page") > before["page"] + 1)
    return placed.withColumn("start", F.when(F.col("route") == "text", start)).drop("_local", "_section_in", "_text_in", "title")


class _Bucket:
    """The blocks of a bucket: which ones a fresh chunk at each of them takes, and which lead on from an open chunk."""

    def __init__(self, sizes: np.ndarray, starts: np.ndarray, limit: int):
        self.count, self.limit = len(sizes), limit
        self.reach = np.concatenate([[0], np.cumsum(sizes + 2)])  # with a blank line after each block
        breaks = np.append(np.flatnonzero(starts), self.count)
        self.lead = int(min(breaks[0], np.searchsorted(self.reach, limit - 1, "right") - 1))
        at = np.arange(self.count)
        full = np.maximum(np.searchsorted(self.reach, self.reach[:-1] + limit + 2, "right") - 1, at + 1)
        self.following = np.minimum(full, breaks[np.searchsorted(breaks, at, "right")])

    def joining(self, open_size: int) -> int:
        """How many leading blocks an open chunk of ``open_size`` characters takes."""
        return min(self.lead, int(np.searchsorted(self.reach, self.limit - open_size, "right")) - 1) if open_size <= self.limit else 0

    def ends(self) -> list[tuple[int, int]]:
        """For a fresh chunk at each of the first lead + 1 blocks: the last chunk's size and first block at the bucket's end."""
        out: list[tuple[int, int]] = [(0, 0)] * self.count
        for i in range(self.count - 1, -1, -1):
            then = int(self.following[i])
            out[i] = out[then] if then < self.count else (int(self.reach[self.count] - self.reach[i]) - 2, i)
        return out[: self.lead + 1]

    def heads(self, first: int) -> np.ndarray:
        """For the blocks from ``first``, where a fresh chunk begins, the first block of their chunk."""
        out = np.empty(self.count - first, np.int64)
        while first < self.count:
            then = int(self.following[first])
            out[first - self.count : then - self.count or None] = first
            first = then
        return out


def _buckets(batches, columns: int = 2):
    """(first row's leading columns, whole table) of each run of rows that agree in the first ``columns``."""
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(columns))))
        cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if now is not None and keys[a] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def _heads(texts: DataFrame, limit: int) -> DataFrame:
    """``texts`` (document_id, _bucket, block_index, size, start) with head: the first block of the packed chunk that each block belongs to."""
    lists = T.ArrayType(T.LongType())
    function = T.StructType([T.StructField("document_id", T.StringType()), T.StructField("_bucket", T.LongType()), T.StructField("lead", lists), T.StructField("sizes", lists), T.StructField("firsts", lists), T.StructField("through", T.BooleanType())])
    entry = T.StructType([T.StructField("document_id", T.StringType()), T.StructField("_bucket", T.LongType()), T.StructField("open_size", T.LongType()), T.StructField("open_head", T.LongType())])
    headed = T.StructType([T.StructField("document_id", T.StringType()), T.StructField("block_index", T.LongType()), T.StructField("head", T.LongType())])
    keys = (pa.string(), pa.int64())

    def bucket_at(table: pa.Table) -> tuple[_Bucket, np.ndarray]:
        return _Bucket(table.column("size").to_numpy(), table.column("start").to_numpy(zero_copy_only=False).astype(bool), limit), table.column("block_index").to_numpy()

    def summed(batches):
        for (document, number), table in _buckets(batches):
            bucket, index = bucket_at(table)
            ends = bucket.ends()
            row = (document, number, bucket.reach[1 : bucket.lead + 1].tolist(), [s for s, _ in ends], [int(index[i]) for _, i in ends], bucket.lead == bucket.count)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (*keys, pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_()))], names=function.fieldNames())

    def composed(batches):
        document, size, head = None, None, None
        for batch in batches:
            rows = []
            for name, number, lead, sizes, firsts, through in zip(*(c.to_pylist() for c in batch.columns)):
                if name != document or size is None:
                    document, size, head = name, None, None
                rows.append((name, number, size, head))
                taken = bisect_right(lead, limit - size) if size is not None else 0
                if through and taken == len(lead) and size is not None:
                    size += lead[-1]
                else:
                    size, head = sizes[taken], firsts[taken]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (*keys, pa.int64(), pa.int64()))], names=entry.fieldNames())

    def placed(batches):
        for (document, _), table in _buckets(batches):
            bucket, index = bucket_at(table)
            size, head = table.column("open_size")[0].as_py(), table.column("open_head")[0].as_py()
            taken = bucket.joining(size) if size is not None else 0
            heads = np.concatenate([np.full(taken, head or 0, np.int64), index[bucket.heads(taken)]])
            yield pa.RecordBatch.from_arrays([pa.array([document] * len(index), pa.string()), pa.array(index), pa.array(heads)], names=headed.fieldNames())

    rows = texts.select("document_id", F.col("_bucket").cast("long").alias("_bucket"), F.col("block_index").cast("long").alias("block_index"), F.col("size").cast("long").alias("size"), "start")
    place = ["document_id", "_bucket", "block_index"]
    functions = rows.repartition("document_id", "_bucket").sortWithinPartitions(*place).mapInArrow(summed, function)
    entries = functions.repartition("document_id").sortWithinPartitions("document_id", "_bucket").mapInArrow(composed, entry)
    both = with_carried(rows, entries, ["document_id"]).repartition("document_id", "_bucket").sortWithinPartitions(*place)
    return both.select(*place, "size", "start", "open_size", "open_head").mapInArrow(placed, headed)


def layout(blocks: DataFrame, title: Column, limit: int = LIMIT, least: int = LEAST, pack_of_signals: dict[str, str] | None = None, bucket: int = BUCKET) -> DataFrame:
    """(document_id, block_index, route, section, page, head, chunk_index) of the blocks that go to text or tables.

    ``blocks``: document_id, block_index (unique in the document), block_type, text, page_idx. Headers,
    footers and page numbers are left out first, so they tell no section. A section lasts until the
    next ``title``. A packed chunk (``head``: its first block) takes the next text while the texts
    joined by blank lines keep to ``limit`` characters, the section is the same and the page at most
    one after the last text's; a longer text is a chunk of its own. A packed chunk under ``least``
    characters joins the chunk before; before any other it is dropped (null ``chunk_index``), unless
    it has a signal. Null pages count as page 0; null and blank texts belong to no chunk. The result
    is written to the shared folder: it holds no texts.
    """
    text = X.normalize_text(F.col("text"))
    narrow = blocks.select("document_id", "block_index", routed(F.col("block_type"), F.col("text")).alias("route"), title.alias("title"), F.coalesce("page_idx", F.lit(0)).alias("page"), text.alias("_text"))
    narrow = narrow.where((F.col("route") != "skip") & (F.col("title").isNotNull() | F.col("route").isin("text", "table")))
    narrow = cut_lineage(narrow.select("document_id", "block_index", "route", "title", "page", F.length("_text").alias("size"), F.when((F.col("route") == "text") & (F.length("_text") < least), F.col("_text")).alias("short_text")))
    rows = cut_lineage(_sectioned(narrow, bucket))
    texts = rows.where("route = 'text'")
    headed = cut_lineage(_heads(texts, limit).join(texts.select("document_id", "block_index", "size", "short_text"), ["document_id", "block_index"]))
    parts = headed.groupBy("document_id", "head").agg((F.sum("size") + 2 * (F.count("*") - 1)).alias("size"), F.array_sort(F.collect_list(F.when(F.col("short_text").isNotNull(), F.struct("block_index", "short_text")))).alias("texts"))
    joined = F.array_join(F.transform("texts", lambda t: t["short_text"]), "\n\n")
    short = F.col("size") < least
    signal = F.when(short, (F.size(S.signals(joined, pack_of_signals)) > 0) | (F.size(S.numeric_mentions(joined)) > 0))
    marked = parts.select("document_id", "head", short.alias("short"), (~short | F.coalesce(signal, F.lit(False))).alias("anchor"))
    first = marked.where("anchor").groupBy("document_id").agg(F.min("head").alias("first"))
    kept = marked.join(first, "document_id").where("head >= first").withColumn("new", (~F.col("short")) | (F.col("head") == F.col("first")))
    numbered_parts = running(kept, ["document_id"], "head", {"n": ("sum", F.col("new").cast("int"))}, bucket).select("document_id", "head", (F.col("n") - 1).cast("int").alias("chunk_index"))
    of_texts = headed.select("document_id", F.col("block_index").cast("int").alias("block_index"), F.col("head").cast("int").alias("head")).join(numbered_parts.withColumn("head", F.col("head").cast("int")), ["document_id", "head"], "left")
    return cut_lineage(rows.where("route IN ('text', 'table')").select("document_id", "block_index", "route", "section", "page").join(of_texts, ["document_id", "block_index"], "left"))


def packed(blocks: DataFrame, placed: DataFrame) -> DataFrame:
    """(document_id, head, first_index, last_index, text, section, page_start, page_end, n_blocks) of the packed chunks, short ones included."""
    rows = _texts(blocks, placed)
    parts = F.array_sort(F.collect_list(F.struct("block_index", "text")))
    return rows.groupBy("document_id", "head").agg(F.min("block_index").alias("first_index"), F.max("block_index").alias("last_index"), F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"), F.min_by("section", "block_index").alias("section"), F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.count("*").cast("int").alias("n_blocks"))


def _texts(blocks: DataFrame, placed: DataFrame) -> DataFrame:
    """The placed texts beside what their blocks say."""
    given = blocks.where(F.col("block_type").isin(*TEXTUAL)).select("document_id", "block_index", "block_type", X.normalize_text(F.col("text")).alias("text"), X.valid_bbox(F.col("bbox")).alias("bbox"))
    return placed.where("route = 'text'").join(given, ["document_id", "block_index"])


def chunks(blocks: DataFrame, placed: DataFrame, pack_of_signals: dict[str, str] | None = None) -> DataFrame:
    """The records of the text chunks of ``blocks`` (with bbox), as ``placed`` by :func:`layout`.

    chunk_id, document_id, source_pdf, chunk_type, chunk_index, page_start, page_end, bbox, section,
    block_types, source_block_indices, text, text_sha256, signals, quality_flags, n_blocks. Section and
    first page are those of the packed chunk that the others joined, and so is text_sha256: it is made
    before short chunks join. Flags are those of the blocks and of the packed chunks.
    """
    rows = _texts(blocks, placed).where("chunk_index IS NOT NULL").repartition("document_id", "chunk_index")
    listed = F.array_sort(F.collect_list(F.struct("block_index", "block_type", "text")))
    part = rows.withColumn("_flags", S.quality_flags(F.col("text"))).groupBy("document_id", "chunk_index", "head").agg(
        listed.alias("b"), F.flatten(F.collect_list("_flags")).alias("_flags"), X.bbox_union(F.col("bbox")).alias("bbox"), F.min_by("section", "block_index").alias("section"), F.min("page").alias("page_start"), F.max("page").alias("page_end")
    )
    said = X.let(F.array_join(F.transform("b", lambda x: x["text"]), "\n\n"), lambda t: F.struct(t.alias("text"), S.quality_flags(t).alias("flags"), F.sha2(t, 256).alias("sha256")))
    part = part.withColumn("_said", said).withColumns({"text": F.col("_said.text"), "_flags": F.concat("_flags", "_said.flags"), "_sha256": F.col("_said.sha256")})
    inner = F.array_sort(F.collect_list(F.struct("head", "b", "text")))
    whole = part.groupBy("document_id", "chunk_index").agg(
        inner.alias("p"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_flags")))).alias("quality_flags"), X.bbox_union(F.col("bbox")).alias("bbox"), F.min_by(F.struct("section", "page_start", "_sha256"), "head").alias("f"), F.max("page_end").alias("page_end")
    )
    own = F.flatten(F.transform("p", lambda x: x["b"]))
    said = X.let(F.array_join(F.transform("p", lambda x: x["text"]), "\n\n"), lambda t: F.struct(t.alias("text"), S.all_signals(t, pack_of_signals).alias("signals")))
    made = whole.withColumn("_said", said).select(
        F.format_string("%s_chunk_%04d", "document_id", "chunk_index").alias("chunk_id"), "document_id", F.concat("document_id", F.lit(".pdf")).alias("source_pdf"), F.lit("text").alias("chunk_type"), "chunk_index", "f.page_start", "page_end", "bbox", "f.section",
        F.array_sort(F.array_distinct(F.transform(own, lambda x: x["block_type"]))).alias("block_types"), F.transform(own, lambda x: x["block_index"]).alias("source_block_indices"), "_said.text", F.col("f._sha256").alias("text_sha256"), "_said.signals", "quality_flags",
    )
    return made.withColumn("n_blocks", F.size("source_block_indices"))


# The types of extraction candidates, in order.
CANDIDATE_TYPES = ("enzyme_identity", "immobilization_strategy", "formulation_condition", "performance_metric", "application_context")


def candidate_types(signals: Column) -> Column:
    """Of the fixed types those among ``signals``, in the fixed order."""
    return F.array_intersect(F.array(*[F.lit(t) for t in CANDIDATE_TYPES]), signals)


def extraction_candidates(text_chunks: DataFrame, tables: DataFrame) -> DataFrame:
    """What records are extracted from: text chunks with a typed signal, and every table.

    ``tables``: the records of :func:`lodestone.operators.tables.records`. Tables have the type
    table_metric besides those of their signals, sorted.
    """
    shared = ["document_id", "source_pdf", "page_start", "page_end", "bbox", "source_id", "source_block_indices", "section", "text", "signals", "quality_flags"]
    a = text_chunks.withColumnRenamed("chunk_id", "source_id").withColumn("candidate_types", candidate_types(F.col("signals"))).where("size(candidate_types) > 0").select(F.lit("rag_chunk").alias("candidate_source"), "candidate_types", *shared)
    b = tables.withColumns({"source_id": F.col("table_id"), "page_start": F.col("page_idx"), "page_end": F.col("page_idx"), "source_block_indices": F.array("source_block_index"), "text": X.lines(F.col("caption"), F.col("text"))})
    b = b.select(F.lit("table_record").alias("candidate_source"), F.array_sort(F.array_distinct(F.concat(candidate_types(F.col("signals")), F.array(F.lit("table_metric"))))).alias("candidate_types"), *shared)
    return a.unionByName(b).withColumn("candidate_id", F.concat(F.lit("cand_"), "source_id"))


def bbox_by_page(blocks: DataFrame) -> DataFrame:
    """(document_id, page_idx, bbox): the box around all valid boxes of a page."""
    box = X.valid_bbox(F.col("bbox"))
    return blocks.withColumn("_box", box).groupBy("document_id", "page_idx").agg(X.bbox_union(F.col("_box")).alias("bbox"))

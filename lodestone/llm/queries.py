"""The queries of this subpackage: name -> callable(spark, folder)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import mixture, near_duplicates, neighbours, residue, scans, split, tokenize
from lodestone.sources.tables import table

#: The keys of items as SQL.
HIT_KEY = "CAST(hit_id AS STRING)"
BLOCK_KEY = "concat_ws('#', document_id, CAST(block_index AS STRING))"


def _oversized(spark: SparkSession, folder: str, operator) -> DataFrame:
    """``operator`` over the two text fields of ``size_limits``, which has one row a field."""
    fields = {"text_blocks.text": (BLOCK_KEY, "text"), "retrieval_hits.source_chunk_text": (HIT_KEY, "source_chunk_text")}
    parts = []
    for row in table(spark, folder, "size_limits").where(F.col("field_name").isin(*fields)).collect():
        key, text = fields[row["field_name"]]
        items = table(spark, folder, row["field_name"].split(".")[0]).select(F.expr(key).alias("item_key"), F.col(text).alias("text"))
        pieces = operator(items, ["item_key"], "text", row["max_chars"], row["overlap_chars"])
        parts.append(pieces.select(F.lit(row["field_name"]).alias("field_name"), "*"))
    return reduce(DataFrame.unionByName, parts)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _oversized(spark, folder, split.oversized)


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every text, once; a repeated row is a full copy, so its pieces are the same."""
    return _oversized(spark, folder, split.split_oversized).dropDuplicates(["field_name", "item_key", "piece_no"])


def _page_texts(spark: SparkSession, folder: str) -> DataFrame:
    blocks = table(spark, folder, "text_blocks").where("block_type IN ('text', 'list')").select(F.lit("text_blocks.text").alias("field_name"), F.expr(BLOCK_KEY).alias("item_key"), "text", "document_id", F.col("page_idx").alias("page"))
    hits = table(spark, folder, "retrieval_hits").select(F.lit("retrieval_hits.text").alias("field_name"), F.expr(HIT_KEY).alias("item_key"), "text", "document_id", F.col("page_start").alias("page"))
    return blocks.unionByName(hits)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    found = scans.repair_scans(_page_texts(spark, folder), ["field_name", "item_key"], "text", "document_id", "page")
    kinds = F.array(F.struct(F.lit("word").alias("kind"), F.col("new_words").alias("pieces")), F.struct(F.lit("line").alias("kind"), F.col("lines").alias("pieces")))
    each = found.where("size(new_words) > 0 OR size(lines) > 0").select("field_name", "item_key", F.explode(kinds).alias("k"))
    return each.select("field_name", "item_key", "k.kind", F.explode("k.pieces").alias("piece")).distinct()


def p2_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """Every scanned or other text once, as continuous paragraphs."""
    return scans.repair_scans(_page_texts(spark, folder), ["field_name", "item_key"], "text", "document_id", "page").dropDuplicates(["field_name", "item_key"])


def _evidence_texts(spark: SparkSession, folder: str) -> DataFrame:
    spans = table(spark, folder, "evidence_records").select(F.lit("evidence_records.evidence_span").alias("field"), F.col("evidence_id").alias("id"), F.col("evidence_span").alias("text"), F.lit(False).alias("is_json"))
    hits = table(spark, folder, "retrieval_hits").where("point_type = 'evidence_record'")
    return spans.unionByName(hits.select(F.lit("retrieval_hits.extracted").alias("field"), F.col("source_id").alias("id"), F.col("extracted").alias("text"), F.lit(True).alias("is_json")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(_evidence_texts(spark, folder))


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(_evidence_texts(spark, folder))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.neighbour_pairs(table(spark, folder, "points", "vec_no", "vector"), "vec_no", "vector", 64)


def p5_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest of every vector, with their cosines."""
    return neighbours.nearest(table(spark, folder, "points", "vec_no", "vector"), "vec_no", "vector", 64)


def p5_exact(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs of p5_found by a search with factor 1, which is exact."""
    return neighbours.neighbour_pairs(table(spark, folder, "points", "vec_no", "vector"), "vec_no", "vector", 64, factor=1.0)


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenize.encode_corpus(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")


def _mixture(spark: SparkSession, folder: str, total: int | str | None = None, targets: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Topics are the sections, without their numbers."""
    documents = table(spark, folder, "documents", "doc_id", "text", "source", "lang", "section").withColumn("topic", F.regexp_replace("section", r"^[\d. ]+", ""))
    return mixture.mix(documents, targets or table(spark, folder, "mix_targets"), "doc_id", "text", "source", "lang", "topic", total)


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder)[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares of the mixture of the corpus's size, and of the largest one in which all shares hold."""
    sizes = [_mixture(spark, folder, total)[1].select(F.lit(name).alias("size"), "*") for name, total in (("corpus", None), ("attainable", "attainable"))]
    return sizes[0].unionByName(sizes[1])


def p8_marginals(spark: SparkSession, folder: str) -> DataFrame:
    """The languages and topics of the mixture in which all shares hold, beside those of the documents it is drawn from."""
    made = _mixture(spark, folder, "attainable")[0]
    documents = _mixture(spark, folder, None, table(spark, folder, "mix_targets").withColumns({"target_share": F.lit(1.0), "max_repeats": F.lit(1)}))[0]
    return mixture.marginals(made, documents)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents", "doc_id", "text", "source", "source_pdf", "lang")
    return residue.find_residue(documents, "doc_id", "text", "source", "source_pdf", "lang").select("doc_id")


def p9_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The documents without residue."""
    return residue.without_residue(table(spark, folder, "documents"), "doc_id", "text", "source", "source_pdf", "lang").select("doc_id", "text", "lang", "source")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p1_pieces": p1_pieces, "p2_found": p2_found, "p2_repaired": p2_repaired, "p4_found": p4_found, "p4_groups": p4_groups, "p5_found": p5_found, "p5_nearest": p5_nearest, "p5_exact": p5_exact, "p7_ids": p7_ids, "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p8_marginals": p8_marginals, "p9_found": p9_found, "p9_clean": p9_clean}

ORACLES: dict[str, str] = {
    "p1_found": """
        SELECT DISTINCT l.field_name, t.document_id || '#' || t.block_index AS item_key
        FROM text_blocks t JOIN size_limits l ON l.field_name = 'text_blocks.text' AND length(t.text) > l.max_chars
        UNION ALL
        SELECT DISTINCT l.field_name, CAST(h.hit_id AS VARCHAR) AS item_key
        FROM retrieval_hits h JOIN size_limits l ON l.field_name = 'retrieval_hits.source_chunk_text' AND length(h.source_chunk_text) > l.max_chars""",
    "p4_found": r"""
        WITH t AS (SELECT DISTINCT 'evidence_records.evidence_span' AS f, evidence_id AS k, evidence_span AS x FROM evidence_records WHERE evidence_span IS NOT NULL
          UNION SELECT DISTINCT 'retrieval_hits.extracted', h.source_id, (SELECT string_agg(j.atom ->> '$', chr(10)) FROM json_tree(h.extracted) j WHERE j.type = 'VARCHAR') FROM retrieval_hits h WHERE point_type = 'evidence_record' AND extracted IS NOT NULL),
         w AS (SELECT DISTINCT f, k, unnest(regexp_extract_all(lower(x), '[\p{L}\p{N}]+')) AS word FROM t),
         n AS (SELECT f, k, count(*) AS n FROM w GROUP BY ALL),
         i AS (SELECT a.f, a.k AS ka, b.k AS kb, count(*) AS i FROM w a JOIN w b ON a.f = b.f AND a.word = b.word AND a.k < b.k GROUP BY ALL)
        SELECT i.f AS field_name, ka AS key_a, kb AS key_b FROM i JOIN n x ON x.f = i.f AND x.k = ka JOIN n y ON y.f = i.f AND y.k = kb WHERE i >= 0.75 * (x.n + y.n - i)""",
    "p5_exact": """
        WITH u AS (SELECT vec_no, vector FROM points WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
         s AS (SELECT a.vec_no AS a, b.vec_no AS b, list_cosine_similarity(a.vector, b.vector) AS c FROM u a JOIN u b ON a.vec_no <> b.vec_no),
         r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS k FROM s)
        SELECT DISTINCT least(a, b) AS vec_no_a, greatest(a, b) AS vec_no_b FROM r WHERE k <= 5""",
}

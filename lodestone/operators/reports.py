"""Counts and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def present(key: Column) -> Column:
    """``key`` as text; null, empty, 0 and false count as missing."""
    plain = key.cast("string")
    return F.when(plain.isNull() | plain.isin("", "0", "false", "0.0"), "<missing>").otherwise(plain)


def count_by(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of a column's values."""
    return df.groupBy(present(F.col(key)).alias("key")).agg(F.count("*").alias("n"))


def count_items(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of a list column's items; null items are not counted."""
    return df.select(F.explode(key).alias("key")).where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"))


def manifest(blocks: DataFrame, text_chunks: DataFrame, tables: DataFrame, candidates: DataFrame) -> DataFrame:
    """Counts of each document: blocks, skipped, texts, pages, tables, chunks of either kind, candidates, characters in text chunks."""
    from lodestone.operators.chunking import routed

    to = blocks.withColumn("_to", routed(F.col("block_type"), F.col("text")))
    counts = to.groupBy("document_id").agg(F.count("*").alias("n_blocks"), F.count_if(F.col("_to") == "skip").alias("n_skipped"), F.count_if(F.col("_to") == "text").alias("n_text"), F.count_distinct("page_idx").alias("n_pages"))
    one = lambda df, name: df.select("document_id", F.lit(name).alias("name"), F.lit(0).alias("n"))
    made = text_chunks.select("document_id", F.lit("n_text_chunks").alias("name"), F.length("text").alias("n")).unionByName(one(tables, "n_tables")).unionByName(one(candidates, "n_candidates"))
    of = lambda name: F.count_if(F.col("name") == name).alias(name)
    totals = made.groupBy("document_id").agg(of("n_text_chunks"), of("n_tables"), of("n_candidates"), F.sum("n").alias("n_chars"))
    whole = counts.join(totals, "document_id", "left").fillna(0, ["n_text_chunks", "n_tables", "n_candidates", "n_chars"])
    return whole.withColumns({"n_table_chunks": F.col("n_tables"), "n_chunks": F.col("n_text_chunks") + F.col("n_tables")})


def validation(records: DataFrame) -> DataFrame:
    """Of each document the records, the review queue, and the distinct flags and reasons."""
    return records.groupBy("document_id").agg(
        F.count("*").alias("n_records"), F.count_if(F.col("requires_review")).alias("n_review"), F.count_if(F.col("confidence") == "low").alias("n_low"), F.sum(F.greatest(F.size("quality_flags"), F.lit(0))).alias("n_flags"), F.sum(F.greatest(F.size("review_reasons"), F.lit(0))).alias("n_reasons")
    )

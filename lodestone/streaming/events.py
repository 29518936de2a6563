"""Response event streams: building, reading, and folding them, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import text as X

EVENT = T.StructType([T.StructField("stream_id", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("event", T.StringType()), T.StructField("delta", T.StringType()), T.StructField("finish_reason", T.StringType())])


def deltas(df: DataFrame, key: str, text: str, width: int = 120) -> DataFrame:
    """(key, seq, delta): the text in slices of ``width`` characters, seq from 0; null and empty texts give none."""
    return df.select(F.col(key), F.posexplode(X.slices(F.col(text), width)).alias("seq", "delta"))


def accumulate(parts: DataFrame, key: str) -> DataFrame:
    """(key, text, n_parts): the deltas of a stream joined in order; null deltas count as empty."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", F.coalesce("delta", F.lit("")).alias("delta"))))
    return parts.groupBy(key).agg(F.array_join(F.transform(ordered, lambda p: p["delta"]), "").alias("text"), F.count("*").alias("n_parts"))


def event_stream(df: DataFrame, key: str, text: str, width: int = 120) -> DataFrame:
    """(key, seq, event, payload): status, deltas and final of each answer, as lines of JSON; error instead if the text is null."""
    body = F.transform(X.slices(F.col(text), width), lambda d: F.struct(F.lit("delta").alias("event"), F.to_json(F.struct(d.alias("delta"))).alias("payload")))
    one = lambda name, payload: F.array(F.struct(F.lit(name).alias("event"), payload.alias("payload")))
    events = F.when(F.col(text).isNull(), F.concat(one("status", F.lit('{"stage":"retrieval"}')), one("error", F.lit('{"message":"no text"}')))).otherwise(
        F.concat(one("status", F.lit('{"stage":"retrieval"}')), one("status", F.lit('{"stage":"generation"}')), body, one("final", F.to_json(F.struct(F.length(text).alias("n_chars")))))
    )
    return df.select(F.col(key), F.posexplode(events).alias("seq", "e")).select(key, "seq", "e.event", "e.payload")


def server_sent(line: Column) -> Column:
    """The payload of a server-sent line: null for blank lines, comments and the end mark."""
    body = X.strip(F.regexp_replace(line, r"^data:", ""))
    return F.when(line.rlike(r"^\s*$") | line.startswith(":") | (body == "[DONE]"), None).otherwise(body)


def read_events(stream: DataFrame) -> DataFrame:
    """The events of a text stream (column value, one JSON object a line); lines that are none are dropped."""
    return stream.select(F.from_json("value", EVENT).alias("e")).where("e.stream_id IS NOT NULL").select("e.*")


def streaming_totals(events: DataFrame) -> DataFrame:
    """Running totals of each stream: deltas, characters, and whether it has ended; for append-only event streams."""
    return events.groupBy("stream_id").agg(F.count_if(F.col("event") == "delta").alias("n_deltas"), F.sum(F.coalesce(F.length("delta"), F.lit(0))).alias("n_chars"), F.max(F.coalesce(F.col("event") == "final", F.lit(False))).alias("ended"))

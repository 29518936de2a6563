"""Queries over readings in different units."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.units import UNITS, _fraction, _names, to_common_units
from lodestone.sources.tables import table


def _readings(spark: SparkSession, folder: str) -> DataFrame:
    """field_name, item_key, pos, quantity, source, seq, value, unit, raw of every reading in the three tables."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))

    def shaped(df: DataFrame, field: str, key: str, quantity, source: str, time: str, reading: str, pos) -> DataFrame:
        at = F.col(reading)
        return df.select(F.lit(field).alias("field_name"), F.col(key).cast("string").alias("item_key"), pos.cast("int").alias("pos"), quantity.alias("quantity"), F.col(source).alias("source"), micros(time).alias("seq"), at["value"].alias("value"), at["unit"].alias("unit"), at["raw"].alias("raw")).where(at.isNotNull())

    hits = table(spark, folder, "retrieval_hits").select("hit_id", "document_id", "retrieved_at", F.posexplode("metrics").alias("pos", "m"))
    parts = [
        shaped(hits, "retrieval_hits.metrics", "hit_id", F.col("m.name"), "document_id", "retrieved_at", "m", F.col("pos")),
        shaped(table(spark, folder, "formulation_inputs"), "formulation_inputs.enzyme_loading", "formulation_id", F.lit("enzyme_loading"), "lab", "submitted_at", "enzyme_loading", F.lit(0)),
        shaped(table(spark, folder, "recommendation_inputs"), "recommendation_inputs.application_context.temperature", "request_id", F.lit("temperature"), "enzyme_source", "submitted_at", "application_context.temperature", F.lit(0)),
    ]
    return reduce(DataFrame.unionByName, parts)


def p3_common(spark: SparkSession, folder: str) -> DataFrame:
    """Every reading once, in its common unit, with how its unit was told."""
    return to_common_units(_readings(spark, folder), table(spark, folder, "common_units"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The readings that tell their value and unit themselves and aren't stored in the common one, as their histories confirm or reverse them."""
    return p3_common(spark, folder).where("how IN ('stated', 'reversed') AND NOT exact").select("field_name", "item_key", "pos", "value_x100")


QUERIES = {"p3_found": p3_found, "p3_common": p3_common}

_WRITTEN = ", ".join(f"('{goal}', '{name}', {float(_fraction(f))!r}, {float(_fraction(o))!r})" for goal, rows in UNITS.items() for f, o, names in rows for name in {*_names(names), *(n.replace("µ", "μ") for n in _names(names)), *(n.replace("°C", "℃") for n in _names(names))})

ORACLES = {
    "p3_found": rf"""
        WITH u(goal, name, f, o) AS (VALUES {_WRITTEN}),
        h AS (SELECT DISTINCT ON (hit_id) * FROM retrieval_hits ORDER BY hit_id, retrieved_at), fi AS (SELECT DISTINCT ON (formulation_id) * FROM formulation_inputs ORDER BY formulation_id, submitted_at), ri AS (SELECT DISTINCT ON (request_id) * FROM recommendation_inputs ORDER BY request_id, submitted_at),
        m AS (SELECT hit_id, unnest(metrics) AS m, generate_subscripts(metrics, 1) - 1 AS pos FROM h),
        a AS (SELECT 'retrieval_hits.metrics' AS field_name, CAST(hit_id AS VARCHAR) AS item_key, pos, m.name AS quantity, m.value AS value, m.unit AS unit, m.raw AS raw FROM m
              UNION ALL SELECT 'formulation_inputs.enzyme_loading', CAST(formulation_id AS VARCHAR), 0, 'enzyme_loading', enzyme_loading.value, enzyme_loading.unit, enzyme_loading.raw FROM fi
              UNION ALL SELECT 'recommendation_inputs.application_context.temperature', CAST(request_id AS VARCHAR), 0, 'temperature', application_context.temperature.value, application_context.temperature.unit, application_context.temperature.raw FROM ri),
        b AS (SELECT a.*, c.common_unit AS goal, replace(regexp_extract(raw, '(\d+(?:[.,]\d+)?)', 1), ',', '.') AS digits, regexp_extract(raw, '\d+(?:[.,]\d+)?(?: × 10\^|e)(-?\d+)', 1) AS power,
                     trim(regexp_replace(regexp_replace(raw, '^[^\d]*\d+(?:[.,]\d+)?(?:(?: × 10\^|e)-?\d+)?', ''), '\(mean of three\)$', '')) AS told
              FROM a JOIN common_units c ON c.field_name = a.field_name AND c.quantity = a.quantity WHERE unit IS DISTINCT FROM c.common_unit OR value IS NULL),
        d AS (SELECT b.*, coalesce(x.f, y.f) AS f, coalesce(x.o, y.o) AS o, coalesce(value, CASE WHEN digits <> '' THEN CAST(digits AS DOUBLE) * pow(10, CASE WHEN power = '' THEN 0 ELSE CAST(power AS INTEGER) END) END) AS v
              FROM b LEFT JOIN u x ON x.goal = b.goal AND x.name = trim(b.unit) LEFT JOIN u y ON y.goal = b.goal AND y.name = b.told AND b.digits <> '')
        SELECT field_name, item_key, CAST(pos AS INTEGER) AS pos, CAST(round(round((v * f + o) * 100, 6)) AS BIGINT) AS value_x100 FROM d WHERE f IS NOT NULL AND v IS NOT NULL""",
}

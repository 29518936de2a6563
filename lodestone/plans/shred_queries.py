"""Queries over nested records as flat child tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.shred import shred_array, shred_json
from lodestone.sources.tables import table


def _children(spark: SparkSession, folder: str, with_fields: bool) -> DataFrame:
    hits, outputs = table(spark, folder, "retrieval_hits"), table(spark, folder, "recommendation_outputs")
    keyed = hits.withColumn("root_key", F.col("hit_id").cast("string"))
    parts = [
        ("retrieval_hits", shred_array(keyed, "root_key", "metrics", with_fields)),
        ("retrieval_hits", shred_json(keyed, "root_key", "extracted", ["conditions", "steps", "additives", "properties"], with_fields=with_fields)),
        ("recommendation_outputs", shred_json(outputs.withColumnRenamed("recommendation_id", "root_key"), "root_key", "candidates", ["candidates", "additives"], with_fields=with_fields)),
    ]
    return reduce(DataFrame.unionByName, [df.select(F.lit(root).alias("root_table"), "*") for root, df in parts])


def p6_children(spark: SparkSession, folder: str) -> DataFrame:
    """root_table, root_key and the columns of the child tables, the fields as a line of text."""
    line = F.array_join(F.array_sort(F.transform(F.map_entries("fields"), lambda f: F.concat(f["key"], F.lit("="), f["value"]))), "; ")
    return _children(spark, folder, True).withColumn("fields", line)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _children(spark, folder, False).select("root_table", "root_key", "child_path")


QUERIES = {"p6_found": p6_found, "p6_children": p6_children}

_NAMES = "('conditions', 'steps', 'additives', 'properties', 'candidates')"
_NODES = rf"""
    h AS (SELECT DISTINCT ON (hit_id) CAST(hit_id AS VARCHAR) AS k, metrics, extracted FROM retrieval_hits ORDER BY hit_id, retrieved_at),
    o AS (SELECT DISTINCT ON (recommendation_id) recommendation_id AS k, candidates FROM recommendation_outputs ORDER BY recommendation_id, created_at),
    v(root_table, k, path, name, j) AS (
      SELECT 'retrieval_hits', k, 'extracted', 'extracted', CAST(extracted AS JSON) FROM h WHERE json_valid(extracted)
      UNION ALL SELECT 'recommendation_outputs', k, 'candidates', 'candidates', CAST(candidates AS JSON) FROM o WHERE json_valid(candidates)
      UNION ALL
      SELECT root_table, k, e.path, e.name, e.j FROM v, LATERAL (
        SELECT CASE WHEN json_type(v.j) = 'VARCHAR' AND v.name IN {_NAMES} AND json_valid(v.j ->> '$') AND json_type(CAST(v.j ->> '$' AS JSON)) IN ('ARRAY', 'OBJECT') THEN CAST(v.j ->> '$' AS JSON) ELSE v.j END AS q) p,
        LATERAL (
          SELECT v.path || '.' || u.key AS path, u.key AS name, json_extract(p.q, '$."' || u.key || '"') AS j FROM (SELECT unnest(json_keys(p.q)) AS key) u WHERE json_type(p.q) = 'OBJECT' AND (v.name = '' OR v.name NOT IN {_NAMES})
          UNION ALL SELECT v.path || '[' || u.i || ']', '', json_extract(p.q, '$[' || u.i || ']') FROM (SELECT unnest(generate_series(0, CAST(json_array_length(p.q) AS BIGINT) - 1)) AS i) u WHERE json_type(p.q) = 'ARRAY'
          UNION ALL SELECT v.path || '[0]', '', p.q WHERE v.name IN {_NAMES} AND json_type(p.q) NOT IN ('ARRAY', 'NULL')) e),
    c AS (SELECT * FROM v WHERE name = '' AND json_type(j) <> 'NULL' AND regexp_matches(path, '(conditions|steps|additives|properties|candidates)\[\d+\]$')),
    m AS (SELECT k, unnest(metrics) AS m, generate_subscripts(metrics, 1) - 1 AS pos FROM h)"""

ORACLES = {
    "p6_found": f"WITH RECURSIVE {_NODES} SELECT root_table, k AS root_key, path AS child_path FROM c UNION ALL SELECT 'retrieval_hits', k, 'metrics[' || pos || ']' FROM m WHERE m IS NOT NULL",
    "p6_children": rf"""WITH RECURSIVE {_NODES},
        f AS (SELECT root_table, k, regexp_extract(path, '^(.*\])', 1) AS elem, coalesce(nullif(ltrim(regexp_replace(path, '^.*\]', ''), '.'), ''), 'value') || '=' || (j ->> '$') AS said FROM v WHERE json_type(j) NOT IN ('OBJECT', 'ARRAY', 'NULL') AND name NOT IN {_NAMES}),
        g AS (SELECT root_table, k, elem, array_to_string(list_sort(list(said)), '; ') AS fields FROM f GROUP BY ALL)
        SELECT c.root_table, c.k AS root_key, regexp_replace(path, '\[\d+\]', '[]', 'g') AS table_path, path AS child_path, nullif(regexp_extract(path, '^(.*\])[^\]]*\[\d+\]$', 1), '') AS parent_path, CAST(regexp_extract(path, '\[(\d+)\]$', 1) AS INTEGER) AS pos, coalesce(fields, '') AS fields
        FROM c LEFT JOIN g ON g.root_table = c.root_table AND g.k = c.k AND g.elem = c.path
        UNION ALL SELECT 'retrieval_hits', k, 'metrics[]', 'metrics[' || pos || ']', NULL, CAST(pos AS INTEGER), concat_ws('; ', 'cycle=' || m.cycle, 'name=' || m.name, 'raw=' || m.raw, 'unit=' || m.unit, 'value=' || m.value) FROM m WHERE m IS NOT NULL""",
}

"""Queries over evidence records, points, hits and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import signals as S
from lodestone.functions import text as X
from lodestone.operators import candidates, compare, contracts, evidence, index, reports, search
from lodestone.sources.tables import table
from lodestone.streaming import events

#: The point whose vector the search queries ask with.
ASKED = 50


def _evidence(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "evidence_records", "evidence_id", *columns).dropDuplicates(["evidence_id"])


def _hits(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "retrieval_hits", "hit_id", *columns).dropDuplicates(["hit_id"])


def _joined(column: str):
    return F.array_join(F.array_sort(column), ",").alias(column)


def review_queue(spark, folder):
    """Records to review, with reasons inferred anew from flags, metrics and reference."""
    rows = _evidence(spark, folder, "quality_flags", "metrics", "extracted")
    flags, metrics = F.coalesce("quality_flags", F.array()), F.coalesce("metrics", F.array().cast(rows.schema["metrics"].dataType))
    reasons = S.review_reasons(flags, metrics, F.get_json_object("extracted", "$.reference"))
    return rows.select("evidence_id", F.array_join(reasons, ",").alias("reasons"), S.confidence(flags).alias("confidence")).where("reasons <> ''")


def evidence_citations(spark, folder):
    c = X.citation(F.col("source_pdf"), F.col("document_id"), F.col("page_start"), F.col("page_end"))
    return _evidence(spark, folder, "source_pdf", "document_id", "page_start", "page_end").select("evidence_id", c.alias("citation"), X.cited_file(c).alias("file"), X.cited_page(c).alias("page"))


def evidence_first(spark, folder):
    """The first of the records that agree in type, source, findings and metrics."""
    rows = table(spark, folder, "evidence_records", "evidence_id", "record_type", "source_id", "extracted", "metrics", "loaded_at")
    keyed = rows.withColumn("canon", evidence.canonical_json(F.col("extracted"))).withColumn("m", F.to_json("metrics"))
    return evidence.first_of_equal(keyed, ["record_type", "source_id", "canon", "m"], ["loaded_at", "evidence_id"]).select("evidence_id")


def evidence_ids(spark, folder):
    """Content-hash ids of all records (no SQL: canonical JSON)."""
    return evidence.with_evidence_ids(_evidence(spark, folder, "record_type", "source_id", "extracted", "metrics", "evidence_span").withColumnRenamed("evidence_id", "stored_id")).select("stored_id", "evidence_id")


def metrics_first(spark, folder):
    """Metrics of each hit without the repeated ones, in order."""
    rows = _hits(spark, folder, "metrics").where("size(metrics) > 0").select("hit_id", F.posexplode(evidence.distinct_metrics(F.filter("metrics", lambda m: m.isNotNull()))).alias("pos", "m"))
    return rows.select("hit_id", "pos", "m.name", "m.value", "m.unit")


def metric_numbers(spark, folder):
    rows = _hits(spark, folder, "metrics").select("hit_id", F.posexplode("metrics").alias("pos", "m"))
    return rows.select("hit_id", "pos", X.first_number(F.col("m.raw")).alias("number")).where("number IS NOT NULL")


def benefits(spark, folder):
    return _hits(spark, folder, "metrics").select("hit_id", F.posexplode(candidates.benefits(F.col("metrics"))).alias("pos", "benefit"))


def record_counts(spark, folder):
    parts = [reports.count_by(_evidence(spark, folder, k), k).select(F.lit(k).alias("counted"), "key", "n") for k in ("record_type", "confidence", "section", "requires_review")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def flag_counts(spark, folder):
    rows = _evidence(spark, folder, "quality_flags", "review_reasons")
    return reports.count_items(rows, "quality_flags").withColumn("counted", F.lit("flag")).unionByName(reports.count_items(rows, "review_reasons").withColumn("counted", F.lit("reason")))


def validation_report(spark, folder):
    return reports.validation(_evidence(spark, folder, "document_id", "requires_review", "confidence", "quality_flags", "review_reasons"))


def corpus_summary(spark, folder):
    """Points by document and type, with totals of either."""
    rows = table(spark, folder, "points", "document_id", "point_type").cube("document_id", "point_type").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
    return rows.select("document_id", "point_type", "n", F.col("level").cast("int").alias("level"))


def point_type_counts(spark, folder):
    return reports.count_by(table(spark, folder, "points", "point_type"), "point_type")


def point_ids(spark, folder):
    """The ids by content key: version 5 UUIDs (DuckDB has none; the tests compare with Python's)."""
    return table(spark, folder, "points", "vec_no", "payload_key").select("vec_no", X.name_uuid(F.col("payload_key")).alias("id"))


def points_upserted(spark, folder):
    """The points of the first half of the time replaced by the later ones of their document and source."""
    rows = table(spark, folder, "points", "source_id", "vec_no", "indexed_at", "citation")
    middle = F.lit("2025-07-01").cast("timestamp_ntz")
    return index.upsert(rows.where(F.col("indexed_at") < middle), rows.where(F.col("indexed_at") >= middle), "source_id", "vec_no").select("source_id", "vec_no", "citation")


def _vector(spark: SparkSession, folder: str) -> list[float]:
    row = table(spark, folder, "points", "vec_no", "vector").where(F.col("vec_no") == ASKED).head()
    return list(row["vector"] or []) if row else []


def _asked(spark, folder) -> DataFrame:
    """The query set: every fiftieth point."""
    return table(spark, folder, "points", "vec_no", "vector").where("vec_no % 50 = 0")


def search_top(spark, folder):
    """The eight most similar usable evidence points of every fiftieth point."""
    rows = table(spark, folder, "points", "vec_no", "vector", "point_type", "usable_for_ranking").where("point_type = 'evidence_record' AND usable_for_ranking")
    return search.search_many(rows, _asked(spark, folder), "vec_no", "vector", 64, 8).select("query", "vec_no", F.round("score", 6).alias("score"))


def search_everything(spark, folder):
    """The twenty most similar points of every fiftieth point, whether usable for ranking or not."""
    found = search.search_many(table(spark, folder, "points", "vec_no", "vector"), _asked(spark, folder), "vec_no", "vector", 64, 20)
    return found.select("query", "vec_no", F.round("score", 6).alias("score"))


def point_scores(spark, folder):
    """The similarity of every vector to the one asked with; none if that has no numbers."""
    rows = table(spark, folder, "points", "vec_no", "vector").where("size(vector) = 64")
    vector = _vector(spark, folder)
    if not vector:
        return rows.select("vec_no", F.lit(None).cast("double").alias("score")).limit(0)
    return rows.select("vec_no", F.round(search.cosine(F.col("vector"), F.array(*[F.lit(float(x)) for x in vector])), 6).alias("score"))


def search_one(spark, folder):
    """The eight most similar usable evidence points of the one asked with, by a plain sort."""
    vector = _vector(spark, folder)
    points = table(spark, folder, "points", "vec_no", "payload_key", "vector", "point_type", "usable_for_ranking")
    found = search.search(points, vector, 8, "evidence_record") if vector else points.limit(0).withColumn("score", F.lit(0.0))
    return found.select("vec_no", "payload_key", F.round("score", 6).alias("score"))


def search_batch(spark, folder):
    """The five most similar points of every fiftieth point, among all points."""
    rows = table(spark, folder, "points", "vec_no", "vector")
    found = search.search_many(rows, rows.where("vec_no % 50 = 0"), "vec_no", "vector", 64)
    return found.select("query", "vec_no", F.round("score", 6).alias("score"))


def requests_named(spark, folder):
    """The enzyme and the query text of each request."""
    rows = table(spark, folder, "recommendation_inputs", "request_id", "enzyme_name", "enzyme_source", "objective").dropDuplicates(["request_id"])
    return rows.select("request_id", X.named_enzyme(F.concat_ws(", ", "enzyme_name", "enzyme_source")).alias("enzyme"), X.query_text(F.col("enzyme_name"), F.col("objective.primary"), fixed="immobilization").alias("query_text"), F.array_join(X.plain_items(F.col("objective.secondary")), ",").alias("secondary"))


def hits_enriched(spark, folder):
    """Hits with the text of their source, found by document and id; texts given are kept. Spans stand for chunks, citations of points for tables."""
    rows = _hits(spark, folder, "document_id", "source_id", "parent_source_id", "source_chunk_text")
    chunks = _evidence(spark, folder, "document_id", "evidence_span").select("document_id", F.col("evidence_id").alias("chunk_id"), F.col("evidence_span").alias("text"))
    tables = table(spark, folder, "points", "document_id", "source_id", "point_type", "citation").where("point_type = 'rag_chunk'").dropDuplicates(["document_id", "source_id"])
    made = search.enrich(rows, chunks, tables.select("document_id", F.col("source_id").alias("table_id"), F.col("citation").alias("text")))
    return made.select("hit_id", F.sha2("source_chunk_text", 256).alias("sha256"))


def hit_parents(spark, folder):
    """Evidence hits with the record they come from."""
    rows = _hits(spark, folder, "source_id", "point_type").where("point_type = 'evidence_record'")
    records = _evidence(spark, folder, "source_id", "record_type").select(F.col("evidence_id").alias("e"), F.col("source_id").alias("parent"), "record_type")
    return rows.join(records, rows["source_id"] == records["e"], "left").select("hit_id", "parent", "record_type")


_SHOWN = ("query_id", "hit_rank", "score", "point_type", "record_type", "source_id", "citation", "usable_for_ranking", "quality_flags")


def hit_contexts(spark, folder):
    """What a generator is shown of each query's hits (no SQL: it shows objects in another notation than JSON)."""
    return search.context(_hits(spark, folder, *_SHOWN, "extracted", "metrics", "text"), "query_id").select("query_id", F.sha2("context", 256).alias("sha256"), F.length("context").alias("n_chars"))


def hit_context_heads(spark, folder):
    """The first two lines of every hit in its context."""
    rows = _hits(spark, folder, *_SHOWN).withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("hit_rank")))
    return rows.select("hit_id", search.context_head(F.col("place")).alias("head"))


def hits_ranked(spark, folder):
    """The three best usable hits of each query, ranked anew."""
    rows = _hits(spark, folder, "query_id", "score", "usable_for_ranking", "source_id").where("usable_for_ranking")
    return search.top_per_group(rows, ["query_id"], [F.col("score").desc(), "hit_id"], 3).select("query_id", "rank", "hit_id", "source_id")


def references_resolved(spark, folder):
    """References of each query: its hits' own ids, citations and ranks, and invented ones, resolved against its hits."""
    hits = _hits(spark, folder, "query_id", "hit_rank", "source_id", "citation").select(F.col("query_id").alias("group_id"), F.col("hit_rank").alias("rank"), "source_id", "citation")
    refs = hits.select("group_id", F.posexplode(F.array(F.concat(F.lit(" "), "source_id"), F.col("citation"), F.col("rank").cast("string"), F.concat(F.lit("ev_fake"), F.col("rank").cast("string")), F.lit(" "), F.lit("99999"))).alias("pos", "ref"), "rank")
    return search.resolve(refs.select("group_id", (F.col("rank") * 10 + F.col("pos")).alias("ord"), "ref"), hits)


def _group_hits(spark, folder, *more: str) -> DataFrame:
    rows = _hits(spark, folder, "query_id", "hit_rank", "source_id", "citation", "record_type", "extracted", "confidence", *more)
    return rows.select(F.col("query_id").alias("group_id"), F.col("hit_rank").alias("rank"), "source_id", "citation", "record_type", "extracted", "confidence", *more)


def settings_compared(spark, folder):
    """Each formulation against the evidence of the query of the same number: the settings that differ, at most six."""
    own = table(spark, folder, "formulation_inputs").dropDuplicates(["formulation_id"])
    tree = F.to_json(F.struct("carrier", F.struct(F.col("enzyme_loading.value"), F.col("enzyme_loading.unit")).alias("enzyme_loading"), F.col("immobilization_conditions.temperature.value").alias("temperature"), F.col("buffer.ph").alias("ph")))
    settings = compare.settings(own.select(F.col("formulation_id").alias("group_id"), tree.alias("tree")), "group_id", "tree")
    found = compare.changes(settings, compare.reference_items(_group_hits(spark, folder)))
    return found.select("group_id", "ord", "field_path", F.regexp_extract("rationale", r"^Evidence reports ([A-Za-z_]+)=", 1).alias("key"), compare.plain(F.col("current_value")).alias("current_value"), F.array_join("evidence_ids", ",").alias("evidence_ids"), F.array_join("citations", ",").alias("citations"), "confidence")


def answer_candidates(spark, folder):
    """The candidates of each query: of the stored answer of the same number where its references hold, else from the hits."""
    answers = table(spark, folder, "recommendation_outputs", "recommendation_id", "request_id", "candidates").dropDuplicates(["recommendation_id"])
    one = answers.groupBy(F.col("request_id").alias("group_id")).agg(F.min_by("candidates", "recommendation_id").alias("candidates"))
    hits = _group_hits(spark, folder, "text", "metrics").withColumn("extracted", F.from_json("extracted", T.MapType(T.StringType(), T.StringType())))
    made = candidates.candidates(one, hits)
    return made.select("group_id", "rank", "origin", F.sha2("strategy_summary", 256).alias("summary"), "carrier", "immobilization_method", F.array_join(F.array_sort(F.map_keys("recommended_conditions")), ",").alias("conditions"), F.array_join("expected_benefits", ",").alias("benefits"), "confidence", F.array_join("evidence_ids", ",").alias("evidence_ids"), F.array_join("citations", ",").alias("citations"))


def evidence_candidates(spark, folder):
    """The candidates that the hits alone give."""
    hits = _group_hits(spark, folder, "text", "metrics").withColumn("extracted", F.from_json("extracted", T.MapType(T.StringType(), T.StringType())))
    made = candidates.from_evidence(hits)
    return made.select("group_id", "rank", "origin", F.sha2("strategy_summary", 256).alias("summary"), F.array_join(F.array_sort(F.map_keys("recommended_conditions")), ",").alias("conditions"), F.array_join("expected_benefits", ",").alias("benefits"), "confidence", F.array_join("evidence_ids", ",").alias("evidence_ids"), F.array_join("citations", ",").alias("citations"))


def answers_rounded_off(spark, folder):
    """What stands beside the candidates of each request: its id, limitations and next experiments, from the hits of the query of the same number."""
    requests = table(spark, folder, "recommendation_inputs", "request_id", "enzyme_name", "objective").dropDuplicates(["request_id"])
    hits = _hits(spark, folder, "query_id", "hit_rank", "source_id", "citation", "requires_review")
    listed = F.array_sort(F.collect_list(F.struct("hit_rank", "source_id", "citation")))
    groups = hits.groupBy(F.col("query_id").alias("request_id")).agg(listed.alias("h"), F.max("requires_review").alias("any_review"))
    joined = requests.join(groups, "request_id", "left").withColumns({"n": F.coalesce(F.size("h"), F.lit(0)), "ids": F.transform("h", lambda x: x["source_id"]), "cited": F.transform("h", lambda x: x["citation"])})
    nothing = F.lit(None).cast("string")
    return joined.select(
        "request_id", candidates.answer_id(F.coalesce("enzyme_name", F.lit("")), F.coalesce("objective.primary", F.lit("")), F.coalesce("ids", F.array().cast("array<string>"))).alias("id"),
        F.array_join(candidates.limitations(F.lit(None).cast("array<string>"), F.greatest("n", F.lit(0)), F.coalesce("any_review", F.lit(False))), "; ").alias("limitations"), F.array_join(candidates.experiments(nothing, F.col("cited"), F.greatest("n", F.lit(0))), ",").alias("experiments"),
    )


def contract_checks(spark, folder):
    rows = _evidence(spark, folder, "metrics", "evidence_span", "confidence", "record_type", "page_start", "page_end")
    m = F.col("metrics")
    return rows.select("evidence_id", contracts.unit_given(m).alias("unit_given"), contracts.some_metric(m).alias("some_metric"), contracts.span_given(F.col("evidence_span")).alias("span_given"), contracts.one_of(F.col("confidence"), contracts.CONFIDENCES).alias("confidence_known"), contracts.one_of(F.col("record_type"), contracts.RECORDS).alias("type_known"), contracts.pages_ordered(F.col("page_start"), F.col("page_end")).alias("pages_ordered"))


def answer_checks(spark, folder):
    rows = table(spark, folder, "recommendation_outputs").dropDuplicates(["recommendation_id"])
    n = F.coalesce(F.json_array_length("candidates"), F.when(F.col("candidates").startswith("{"), 1), F.lit(0))
    return rows.select("recommendation_id", contracts.answer_shape(F.col("answer_type"), n, F.col("abstention_reason")).alias("valid"), n.cast("int").alias("n_candidates"))


def first_conditions(spark, folder):
    """Of each query the first condition record with findings."""
    rows = _hits(spark, folder, "query_id", "hit_rank", "record_type", "extracted").where("record_type = 'formulation_condition' AND extracted IS NOT NULL AND extracted <> '{}'")
    return rows.groupBy("query_id").agg(F.min_by("hit_id", "hit_rank").alias("hit_id"))


def answer_slices(spark, folder):
    """Texts of the documents in slices."""
    return events.deltas(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", 400)


def answer_joined(spark, folder):
    parts = events.accumulate(answer_slices(spark, folder), "doc_id")
    return parts.select("doc_id", F.sha2("text", 256).alias("sha256"), "n_parts")


def answer_events(spark, folder):
    rows = events.event_stream(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", 400)
    return rows.groupBy("doc_id", "event").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def orders_pending(spark, folder):
    """Customers without an order: the set difference by which a run resumes."""
    customers, orders = table(spark, folder, "customer", "c_custkey"), table(spark, folder, "orders", "o_custkey")
    return customers.join(orders, customers["c_custkey"] == orders["o_custkey"], "left_anti")


def latest_events(spark, folder):
    """Of each user the latest event, ties by the higher id."""
    return table(spark, folder, "events", "user_id", "ts", "event_id", "event_type").groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("e")).select("user_id", "e.event_id", "e.event_type")


def names_shortest(spark, folder):
    """Of each brand the part with the shortest name, then the first by name and key."""
    return table(spark, folder, "part", "p_brand", "p_name", "p_partkey").groupBy("p_brand").agg(F.min_by("p_partkey", F.struct(F.length("p_name"), "p_name", "p_partkey")).alias("p_partkey"))


QUERIES = {
    f.__name__: f
    for f in (
        review_queue, evidence_citations, evidence_first, evidence_ids, metrics_first, metric_numbers, benefits, record_counts, flag_counts, validation_report, corpus_summary, point_type_counts, point_ids, points_upserted, search_top, search_everything, search_one, search_batch, requests_named, point_scores,
        hits_enriched, hit_parents, hit_contexts, hit_context_heads, hits_ranked, references_resolved, settings_compared, answer_candidates, evidence_candidates, answers_rounded_off, contract_checks, answer_checks, first_conditions, answer_slices, answer_joined, answer_events, orders_pending, latest_events, names_shortest,
    )
}

_E = "e AS (SELECT DISTINCT ON (evidence_id) * FROM evidence_records ORDER BY evidence_id, loaded_at)"
_H = "h AS (SELECT DISTINCT ON (hit_id) * FROM retrieval_hits ORDER BY hit_id, retrieved_at)"
_CITED = "CASE WHEN page_start IS NULL THEN f WHEN page_end IS NULL OR page_end = page_start THEN f || ':p' || (page_start + 1) ELSE f || ':p' || (page_start + 1) || '-p' || (page_end + 1) END"
_M = "m AS (SELECT hit_id, unnest(metrics) AS m, generate_subscripts(metrics, 1) - 1 AS pos FROM h)"
_COUNT = lambda key: f"SELECT '{key}' AS counted, CASE WHEN {key} IS NULL OR CAST({key} AS VARCHAR) IN ('', 'false') THEN '<missing>' ELSE CAST({key} AS VARCHAR) END AS key, count(*) AS n FROM e GROUP BY 2"
_Q = f"q AS (SELECT vector AS v FROM points WHERE vec_no = {ASKED})"
_DOT = lambda a, b: f"list_sum(list_transform(generate_series(1, 64), lambda i: {a}[i] * {b}[i]))"
_SCORE = f"CASE WHEN {_DOT('vector', 'vector')} > 0 THEN {_DOT('vector', 'v')} / (sqrt({_DOT('vector', 'vector')}) * sqrt({_DOT('v', 'v')})) ELSE 0 END"
_NUMBER = r"regexp_replace(CAST(CAST(%s AS DECIMAL(30, 8)) AS VARCHAR), '(\.\d+?)0+$', '\1')"
_SEARCH = """WITH u AS (SELECT * FROM points WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: x <> 0)) > 0), s AS (SELECT q.vec_no AS query, p.vec_no AS vec_no, list_cosine_similarity(q.vector, p.vector) AS score FROM u q JOIN (SELECT * FROM u WHERE {where}) p ON q.vec_no % 50 = 0 AND p.vec_no <> q.vec_no),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_no) AS k FROM s) SELECT query, vec_no, round(score, 6) AS score FROM r WHERE k <= {k}"""
_PARTS = "d AS (SELECT doc_id, text, CAST(ceil(length(text) / 400) AS BIGINT) AS n FROM documents), s AS (SELECT doc_id, text, n, unnest(generate_series(0, n - 1)) AS seq FROM d WHERE n > 0)"
_REF = "coalesce(json_extract_string(extracted, '$.reference'), '')"

ORACLES = {
    "review_queue": f"""WITH {_E}, r AS (SELECT evidence_id, len(quality_flags) > 0 AS flagged, len(list_filter(metrics, lambda m: m.unit IS NULL)) > 0 AS bare,
            len(list_filter(metrics, lambda m: m.name IN ('activity_recovery', 'biodiesel_yield') AND m.value > 100)) > 0 AS over, {_REF} NOT IN ('', 'This study') AND NOT starts_with({_REF}, '[') AS bad FROM e),
        s AS (SELECT evidence_id, concat_ws(',', CASE WHEN bad THEN 'malformed_reference' END, CASE WHEN bare THEN 'metric_missing_unit' END, CASE WHEN over THEN 'metric_percent_gt_100' END, CASE WHEN flagged THEN 'upstream_quality_flags' END) AS reasons, CASE WHEN flagged THEN 'low' ELSE 'medium' END AS confidence FROM r)
        SELECT * FROM s WHERE reasons <> ''""",
    "evidence_citations": rf"WITH {_E}, c AS (SELECT *, coalesce(nullif(source_pdf, ''), nullif(document_id, ''), '<unknown>') AS f FROM e), d AS (SELECT evidence_id, f, {_CITED} AS citation, page_start FROM c) SELECT evidence_id, citation, f AS file, page_start + 1 AS page FROM d",
    "metrics_first": f"WITH {_H}, {_M}, r AS (SELECT hit_id, pos, m.name AS name, m.value AS value, m.unit AS unit, row_number() OVER (PARTITION BY hit_id, m.name, m.value, m.unit, m.cycle ORDER BY pos) AS k FROM m WHERE m IS NOT NULL) SELECT hit_id, CAST(row_number() OVER (PARTITION BY hit_id ORDER BY pos) - 1 AS INTEGER) AS pos, name, value, unit FROM r WHERE k = 1",
    "metric_numbers": rf"WITH {_H}, {_M} SELECT hit_id, CAST(pos AS INTEGER) AS pos, CAST(nullif(regexp_extract(m.raw, '\d+(?:\.\d+)?'), '') AS DOUBLE) AS number FROM m WHERE regexp_matches(m.raw, '\d')",
    "benefits": rf"WITH {_H}, {_M}, t AS (SELECT hit_id, row_number() OVER (PARTITION BY hit_id ORDER BY pos) - 1 AS pos, m FROM m WHERE m.name <> '' AND m.value IS NOT NULL) SELECT hit_id, CAST(pos AS INTEGER) AS pos, m.name || ': ' || {_NUMBER % 'm.value'} || coalesce(m.unit, '') AS benefit FROM t",
    "record_counts": f"WITH {_E} " + " UNION ALL ".join(_COUNT(k) for k in ("record_type", "confidence", "section", "requires_review")),
    "flag_counts": f"WITH {_E}, a AS (SELECT 'flag' AS counted, unnest(quality_flags) AS key FROM e UNION ALL SELECT 'reason', unnest(review_reasons) FROM e) SELECT counted, key, count(*) AS n FROM a WHERE key IS NOT NULL GROUP BY 1, 2",
    "validation_report": f"WITH {_E} SELECT document_id, count(*) AS n_records, count(*) FILTER (requires_review) AS n_review, count(*) FILTER (confidence = 'low') AS n_low, CAST(sum(coalesce(len(quality_flags), 0)) AS BIGINT) AS n_flags, CAST(sum(coalesce(len(review_reasons), 0)) AS BIGINT) AS n_reasons FROM e GROUP BY 1",
    "corpus_summary": "SELECT document_id, point_type, count(*) AS n, CAST(grouping(document_id, point_type) AS INTEGER) AS level FROM points GROUP BY CUBE (document_id, point_type)",
    "point_type_counts": "SELECT point_type AS key, count(*) AS n FROM points GROUP BY 1",
    "points_upserted": """WITH n AS (SELECT * FROM points WHERE indexed_at >= TIMESTAMP '2025-07-01'), o AS (SELECT * FROM points WHERE indexed_at < TIMESTAMP '2025-07-01')
        SELECT source_id, vec_no, citation FROM o WHERE source_id NOT IN (SELECT source_id FROM n) UNION ALL SELECT source_id, max(vec_no) AS vec_no, arg_max(citation, vec_no) AS citation FROM n GROUP BY source_id""",
    "search_top": _SEARCH.format(where="point_type = 'evidence_record' AND usable_for_ranking", k=8),
    "search_one": f"WITH {_Q}, s AS (SELECT vec_no, payload_key, {_SCORE} AS score FROM points, q WHERE len(vector) = 64 AND point_type = 'evidence_record' AND usable_for_ranking ORDER BY score DESC, payload_key LIMIT 8) SELECT vec_no, payload_key, round(score, 6) AS score FROM s",
    "search_everything": _SEARCH.format(where="TRUE", k=20),
    "point_scores": f"WITH {_Q} SELECT vec_no, round({_SCORE}, 6) AS score FROM points, q WHERE len(vector) = 64",
    "search_batch": _SEARCH.format(where="TRUE", k=5),
    "requests_named": f"""WITH r AS (SELECT DISTINCT ON (request_id) *, concat_ws(', ', enzyme_name, enzyme_source) AS t FROM recommendation_inputs ORDER BY request_id, submitted_at)
        SELECT request_id, CASE WHEN contains(lower(t), 'burkholderia cepacia lipase') OR contains(lower(t), 'bcl') THEN 'Burkholderia cepacia lipase' WHEN contains(lower(t), 'lipase') THEN 'lipase' ELSE trim(regexp_extract(t, '^[^，,。.\\n]*')) END AS enzyme,
               concat_ws(' ', nullif(trim(enzyme_name), ''), nullif(trim(objective.primary), ''), 'immobilization') AS query_text, coalesce(array_to_string(list_filter(list_transform(objective.secondary, lambda x: trim(x)), lambda x: x <> ''), ','), '') AS secondary FROM r""",
    "hits_enriched": f"""WITH {_H}, {_E}, c AS (SELECT document_id AS d, evidence_id AS k, any_value(evidence_span) AS x FROM e GROUP BY 1, 2), p AS (SELECT document_id AS d, source_id AS k, any_value(citation) AS x FROM points WHERE point_type = 'rag_chunk' GROUP BY 1, 2)
        SELECT hit_id, sha256(coalesce(nullif(source_chunk_text, ''), p.x, c.x)) AS sha256 FROM h LEFT JOIN p ON p.d = h.document_id AND p.k = coalesce(nullif(parent_source_id, ''), source_id) LEFT JOIN c ON c.d = h.document_id AND c.k = coalesce(nullif(parent_source_id, ''), source_id)""",
    "hit_parents": f"WITH {_H}, {_E} SELECT h.hit_id, e.source_id AS parent, e.record_type FROM h LEFT JOIN e ON h.source_id = e.evidence_id WHERE h.point_type = 'evidence_record'",
    "hits_ranked": f"WITH {_H}, r AS (SELECT query_id, hit_id, source_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hit_id) AS INTEGER) AS rank FROM h WHERE usable_for_ranking) SELECT query_id, rank, hit_id, source_id FROM r WHERE rank <= 3",
    "hit_context_heads": f"""WITH {_H}, b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hit_rank) AS place FROM h)
        SELECT hit_id, format('[{{}}] score={{}} type={{}} record_type={{}}', place, format('{{:.4f}}', CAST(round(CAST(score AS DECIMAL(18, 8)), 4) AS DOUBLE)), coalesce(point_type, ''), coalesce(nullif(record_type, ''), '-')) || chr(10) || format('source_id={{}} citation={{}} usable={{}} flags=[{{}}]', coalesce(source_id, ''),
               coalesce(nullif(citation, ''), '-'), CASE WHEN usable_for_ranking THEN 'True' ELSE 'False' END, coalesce(array_to_string(list_transform(quality_flags, lambda x: '''' || x || ''''), ', '), '')) AS head FROM b""",
    "references_resolved": f"""WITH {_H}, f AS (SELECT query_id AS group_id, hit_rank AS rank, source_id, citation FROM h),
        r AS (SELECT group_id, rank * 10 AS ord, source_id AS ref FROM f UNION ALL SELECT group_id, rank * 10 + 1, citation FROM f UNION ALL SELECT group_id, rank * 10 + 2, CAST(rank AS VARCHAR) FROM f UNION ALL SELECT group_id, rank * 10 + 5, '99999' FROM f),
        a AS (SELECT group_id, source_id AS ref, 0 AS p, max(rank) AS rank FROM f GROUP BY 1, 2 UNION ALL SELECT group_id, citation, 1, max(rank) FROM f WHERE citation IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT group_id, CAST(rank AS VARCHAR), 2, rank FROM f),
        b AS (SELECT group_id, ref, arg_min(rank, p) AS rank FROM a GROUP BY 1, 2)
        SELECT r.group_id, r.ord, r.ref, f.source_id, f.citation FROM r JOIN b ON b.group_id = r.group_id AND b.ref = r.ref JOIN f ON f.group_id = b.group_id AND f.rank = b.rank""",
    "contract_checks": f"""WITH {_E} SELECT evidence_id, NOT coalesce(len(list_filter(metrics, lambda m: m.value IS NOT NULL AND m.unit IS NULL)) > 0, FALSE) AS unit_given, coalesce(len(list_filter(metrics, lambda m: m.value IS NOT NULL)) > 0, FALSE) AS some_metric, coalesce(regexp_matches(evidence_span, '\\S'), FALSE) AS span_given,
        coalesce(confidence IN ('low', 'medium', 'high'), FALSE) AS confidence_known, coalesce(record_type IN {contracts.RECORDS}, FALSE) AS type_known, page_start IS NULL OR page_end IS NULL OR page_start <= page_end AS pages_ordered FROM e""",
    "answer_checks": """WITH o AS (SELECT DISTINCT ON (recommendation_id) * FROM recommendation_outputs ORDER BY recommendation_id, created_at),
        n AS (SELECT *, CASE WHEN starts_with(candidates, '[') THEN CAST(json_array_length(candidates) AS INTEGER) WHEN starts_with(candidates, '{') THEN 1 ELSE 0 END AS n FROM o)
        SELECT recommendation_id, CASE WHEN answer_type = 'ranked_candidates' THEN n > 0 WHEN answer_type = 'abstention' THEN coalesce(abstention_reason <> '', FALSE) ELSE TRUE END AS valid, CAST(n AS INTEGER) AS n_candidates FROM n""",
    "first_conditions": f"WITH {_H} SELECT query_id, arg_min(hit_id, hit_rank) AS hit_id FROM h WHERE record_type = 'formulation_condition' AND extracted IS NOT NULL AND extracted <> '{{}}' GROUP BY 1",
    "answer_slices": f"WITH {_PARTS} SELECT doc_id, CAST(seq AS INTEGER) AS seq, substr(text, seq * 400 + 1, 400) AS delta FROM s",
    "answer_joined": f"WITH {_PARTS} SELECT doc_id, sha256(text) AS sha256, n AS n_parts FROM d WHERE n > 0",
    "answer_events": f"""WITH {_PARTS} SELECT doc_id, 'status' AS event, CAST(CASE WHEN text IS NULL THEN 1 ELSE 2 END AS BIGINT) AS n, 0 AS first_seq, CAST(CASE WHEN text IS NULL THEN 0 ELSE 1 END AS INTEGER) AS last_seq FROM d
        UNION ALL SELECT doc_id, 'error', 1, 1, 1 FROM d WHERE text IS NULL UNION ALL SELECT doc_id, 'delta', n, 2, CAST(n + 1 AS INTEGER) FROM d WHERE n > 0 UNION ALL SELECT doc_id, 'final', 1, CAST(n + 2 AS INTEGER), CAST(n + 2 AS INTEGER) FROM d WHERE text IS NOT NULL""",
    "orders_pending": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)",
    "latest_events": "SELECT DISTINCT ON (user_id) user_id, event_id, event_type FROM events ORDER BY user_id, ts DESC, event_id DESC",
    "names_shortest": "SELECT DISTINCT ON (p_brand) p_brand, p_partkey FROM part ORDER BY p_brand, length(p_name), p_name, p_partkey",
    "settings_compared": f"""WITH {_H}, f AS (SELECT DISTINCT ON (formulation_id) * FROM formulation_inputs ORDER BY formulation_id, submitted_at),
        own AS (SELECT formulation_id AS group_id, 'carrier' AS setting, to_json(carrier) AS value FROM f WHERE carrier IS NOT NULL UNION ALL SELECT formulation_id, 'enzyme_loading', to_json({{'unit': enzyme_loading.unit, 'value': enzyme_loading.value}}) FROM f UNION ALL SELECT formulation_id, 'temperature', to_json(immobilization_conditions.temperature.value) FROM f
                WHERE immobilization_conditions.temperature.value IS NOT NULL UNION ALL SELECT formulation_id, 'pH', to_json(buffer.ph) FROM f WHERE buffer.ph IS NOT NULL),
        k AS (SELECT query_id AS group_id, hit_rank, source_id, citation, confidence, extracted, unnest(json_keys(extracted)) AS key, generate_subscripts(json_keys(extracted), 1) AS seq FROM h WHERE record_type IN {compare.SOURCES} AND json_valid(extracted) AND json_type(extracted) = 'OBJECT'),
        i AS (SELECT *, json_extract(extracted, '$."' || key || '"') AS value FROM k WHERE key IN {compare.COMPARED}),
        j AS (SELECT i.*, own.value AS current, CASE key {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in compare.PLACE.items())} ELSE key END AS field_path FROM i LEFT JOIN own ON own.group_id = i.group_id AND own.setting = CASE lower(key) {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in compare.ALIAS.items())} ELSE lower(key) END
              WHERE json_type(i.value) <> 'NULL' AND CAST(i.value AS VARCHAR) NOT IN ('""', '[]')),
        d AS (SELECT *, row_number() OVER (PARTITION BY group_id, field_path ORDER BY hit_rank, seq) AS n FROM j WHERE NOT coalesce(CASE WHEN TRY_CAST(current AS DOUBLE) IS NOT NULL AND json_type(value) IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN abs(CAST(current AS DOUBLE) - CAST(value AS DOUBLE)) < 1e-9 ELSE lower(trim(current ->> '$')) = lower(trim(value ->> '$')) END, FALSE)),
        o AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY hit_rank, seq) AS ord FROM d WHERE n = 1)
        SELECT group_id, CAST(ord AS INTEGER) AS ord, field_path, key, CASE WHEN json_type(current) = 'OBJECT' THEN replace(replace(replace(CAST(current AS VARCHAR), '":', '": '), ',"', ', "'), '"unit": null, ', '') ELSE current ->> '$' END AS current_value, source_id AS evidence_ids, coalesce(citation, '') AS citations, coalesce(nullif(confidence, ''), 'medium') AS confidence FROM o WHERE ord <= 6""",
    "evidence_candidates": f"""WITH {_H}, x AS (SELECT *, query_id AS group_id, CASE WHEN json_valid(extracted) AND json_type(extracted) = 'OBJECT' THEN extracted END AS j FROM h),
        g AS (SELECT *, nullif(json_extract_string(j, '$.carrier'), '') AS c, nullif(json_extract_string(j, '$.carrier_variant'), '') AS v, nullif(json_extract_string(j, '$.immobilization_method'), '') AS m, record_type = 'table_comparison_row' AS is_row FROM x),
        f AS (SELECT *, coalesce(record_type IN {candidates.STRATEGIES} AND (c IS NOT NULL OR v IS NOT NULL OR m IS NOT NULL OR is_row), FALSE) AS fits FROM g),
        k AS (SELECT *, bool_or(fits) OVER (PARTITION BY group_id) AS anyfit, row_number() OVER (PARTITION BY group_id ORDER BY fits DESC, hit_rank, source_id) AS n FROM f),
        w AS (SELECT group_id, arg_min(j, hit_rank) AS w FROM f WHERE record_type = 'formulation_condition' AND j IS NOT NULL AND len(json_keys(j)) > 0 GROUP BY 1)
        SELECT k.group_id, CAST(n AS INTEGER) AS rank, CASE WHEN fits THEN 'evidence' ELSE 'fallback' END AS origin,
               sha256(CASE WHEN NOT fits THEN coalesce(nullif(substr(text, 1, 300), ''), 'retrieved evidence') WHEN is_row THEN coalesce(nullif(json_extract_string(j, '$.enzyme_name'), ''), 'enzyme') || ' in ' || coalesce(nullif(json_extract_string(j, '$.substrate'), ''), 'substrate') || ' system with ' || coalesce(nullif(json_extract_string(j, '$.acyl_acceptor'), ''), 'acyl acceptor')
                           WHEN coalesce(v, c) IS NOT NULL AND m IS NOT NULL THEN m || ' on ' || coalesce(v, c) ELSE substr(coalesce(text, ''), 1, 180) END) AS summary,
               array_to_string(list_sort(list_distinct(list_concat(CASE WHEN fits THEN list_filter(coalesce(json_keys(j), []), lambda y: y NOT IN {candidates.NOT_CONDITIONS}) ELSE [] END, coalesce(json_keys(w), [])))), ',') AS conditions,
               coalesce(array_to_string(list_transform(list_filter(metrics, lambda y: y.name <> '' AND y.value IS NOT NULL), lambda y: y.name || ': ' || {_NUMBER % 'y.value'} || coalesce(y.unit, '')), ','), '') AS benefits,
               coalesce(nullif(confidence, ''), CASE WHEN fits THEN 'medium' ELSE 'low' END) AS confidence, source_id AS evidence_ids, coalesce(citation, '') AS citations
        FROM k LEFT JOIN w ON w.group_id = k.group_id WHERE CASE WHEN anyfit THEN fits AND n <= 3 ELSE n = 1 END""",
    "answers_rounded_off": f"""WITH {_H}, r AS (SELECT DISTINCT ON (request_id) * FROM recommendation_inputs ORDER BY request_id, submitted_at),
        g AS (SELECT query_id, list(source_id ORDER BY hit_rank, source_id) AS ids, list(citation ORDER BY hit_rank, source_id) AS cited, bool_or(requires_review) AS review, count(*) AS n FROM h GROUP BY 1)
        SELECT request_id, 'rec_' || substr(sha1(coalesce(enzyme_name, '') || '|' || coalesce(objective.primary, '') || '|' || coalesce(array_to_string(ids[:5], ','), '')), 1, 12) AS id,
               concat_ws('; ', CASE WHEN n IS NULL THEN '{candidates.NO_EVIDENCE}' END, CASE WHEN review THEN '{candidates.TO_REVIEW}' END) AS limitations,
               CASE WHEN n IS NULL THEN '' ELSE CAST(to_json({{'variable': '{candidates.EXPERIMENT[0]}', 'metric': '{candidates.EXPERIMENT[1]}', 'evidence_basis': list_filter(cited[:3], lambda x: x IS NOT NULL)}}) AS VARCHAR) END AS experiments
        FROM r LEFT JOIN g ON g.query_id = r.request_id""",
}

"""Queries over document blocks, chunks and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import signals as S
from lodestone.functions import text as X
from lodestone.operators import chunking, evidence, index, reports, tables
from lodestone.session import cut_lineage
from lodestone.sources.files import block_text
from lodestone.sources.tables import table

BLOCK = ["document_id", "block_index"]


def _blocks(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Every block once; a repeated row is a full copy."""
    return table(spark, folder, "text_blocks", *BLOCK, *columns).dropDuplicates(BLOCK)


def text_normalized(spark, folder):
    t = F.col("text")
    return _blocks(spark, folder, "text").select(*BLOCK, F.sha2(X.normalize_text(t), 256).alias("normal"), F.sha2(X.normalize_space(t), 256).alias("spaced"), F.length(X.strip(t)).alias("n_stripped"), F.sha2(t, 256).alias("sha256"))


def text_scientific(spark, folder):
    return _blocks(spark, folder, "text").select(*BLOCK, X.normalize_scientific(F.col("text")).alias("scientific")).where("scientific IS NOT NULL")


def text_spans(spark, folder):
    return _blocks(spark, folder, "text").select(*BLOCK, X.select_span(F.col("text"), "activity").alias("span")).where("span <> ''")


def text_escaped(spark, folder):
    return _blocks(spark, folder, "text").select(*BLOCK, X.escaped_json(F.col("text")).alias("escaped")).where("escaped IS NOT NULL")


def list_fallback(spark, folder):
    """Lists whose text is empty fall back to their body; here the section stands for it."""
    return _blocks(spark, folder, "block_type", "text", "section").select(*BLOCK, F.length(block_text(F.col("block_type"), F.col("text"), F.col("section"))).alias("n_chars"))


def blocks_routed(spark, folder):
    rows = _blocks(spark, folder, "block_type", "text").withColumn("route", chunking.routed(F.col("block_type"), F.col("text")))
    return rows.groupBy("document_id", "route").agg(F.count("*").alias("n"))


def page_boxes(spark, folder):
    return chunking.bbox_by_page(_blocks(spark, folder, "page_idx", "bbox"))


def section_titles(spark, folder):
    rows = _blocks(spark, folder, "text", "section").select(*BLOCK, chunking.section_title(F.lit(None).cast("int"), F.col("section")).alias("title"))
    return rows.where("title IS NOT NULL")


def _title():
    """A block's title: its text if it is a numbered heading, else the section stored with it (these tables have no levels)."""
    return F.coalesce(chunking.section_title(F.lit(None).cast("int"), X.normalize_text(F.col("text"))), F.col("section"))


def sections_carried(spark, folder):
    rows = _blocks(spark, folder, "block_type", "text", "section").where(~F.coalesce(F.col("block_type").isin(*chunking.SKIPPED), F.lit(False)))
    return chunking.with_sections(rows.select(*BLOCK, _title().alias("title")), F.col("title"), "carried").select(*BLOCK, "carried")


def _full(spark, folder) -> DataFrame:
    return _blocks(spark, folder, "block_type", "text", "page_idx", "bbox", "section")


def _layout(spark, folder) -> DataFrame:
    return chunking.layout(_blocks(spark, folder, "block_type", "text", "page_idx", "section"), _title())


def chunks_packed(spark, folder):
    made = chunking.packed(_full(spark, folder), _layout(spark, folder))
    return made.select("document_id", "first_index", "last_index", "n_blocks", "section", "page_start", "page_end", F.sha2("text", 256).alias("sha256"))


def chunks_merged(spark, folder):
    """The full record of every text chunk."""
    made = chunking.chunks(_full(spark, folder), _layout(spark, folder))
    flat = [F.array_join(c, ",").alias(c) for c in ("block_types", "source_block_indices", "signals", "quality_flags")]
    return made.select("chunk_id", "document_id", "source_pdf", "chunk_index", "section", "page_start", "page_end", "bbox", "n_blocks", "text_sha256", F.sha2("text", 256).alias("full_sha256"), *flat)


def _table_records(spark, folder, placed: DataFrame) -> DataFrame:
    """The tables, which are stored as lines, with the section they stand in."""
    columns, rows = tables.linear_table(F.col("text"))
    own = _blocks(spark, folder, "block_type", "text", "page_idx", "bbox").where("block_type = 'table'").select(*BLOCK, "page_idx", "bbox", columns.alias("columns"), rows.alias("rows"), F.lit(None).cast("string").alias("caption"))
    return tables.records(own.join(placed.where("route = 'table'").select(*BLOCK, "section"), BLOCK))


def table_full(spark, folder):
    """The full record of every table, with the chunk that mirrors it."""
    made = cut_lineage(_table_records(spark, folder, _layout(spark, folder)))
    mirrored = tables.chunks(made).select("table_id", "chunk_id", F.col("text").alias("chunk_text"))
    joined = made.join(mirrored, "table_id")
    return joined.select("table_id", "chunk_id", "source_block_index", "page_idx", "section", F.array_join("columns", "|").alias("columns"), "row_count", F.sha2("text", 256).alias("sha256"), F.length("chunk_text").alias("n_chars"), F.array_join("signals", ",").alias("signals"), F.array_join("quality_flags", ",").alias("flags"))


def _candidates(spark, folder, placed: DataFrame, made_tables: DataFrame) -> DataFrame:
    return chunking.extraction_candidates(chunking.chunks(_full(spark, folder), placed), made_tables)


def candidates_built(spark, folder):
    """What records are extracted from."""
    placed = _layout(spark, folder)
    made = _candidates(spark, folder, placed, _table_records(spark, folder, placed))
    return made.select("candidate_id", "candidate_source", "source_id", "section", "page_start", "page_end", F.array_join("candidate_types", ",").alias("types"), F.sha2("text", 256).alias("sha256"), F.array_join("quality_flags", ",").alias("flags"))


def chunk_manifest(spark, folder):
    """Counts of every document."""
    placed = _layout(spark, folder)
    made_tables = _table_records(spark, folder, placed)
    made = cut_lineage(chunking.chunks(_full(spark, folder), placed))
    return reports.manifest(_blocks(spark, folder, "block_type", "page_idx", "text"), made, made_tables, chunking.extraction_candidates(made, made_tables))


def html_tables(spark, folder):
    """The tables written as HTML and parsed again, row by row."""
    columns, rows = tables.linear_table(F.col("text"))
    own = _blocks(spark, folder, "block_type", "text").where("block_type = 'table'").select(*BLOCK, tables.parse_html(tables.to_html(columns, rows)).alias("grid"))
    return own.select(*BLOCK, F.posexplode("grid").alias("row_index", "cells")).select(*BLOCK, "row_index", F.array_join("cells", "|").alias("cells"))


def block_signals(spark, folder):
    return _blocks(spark, folder, "text").select(*BLOCK, F.array_join(S.signals(F.col("text")), ",").alias("signals"), F.array_join(S.numeric_mentions(F.col("text")), ",").alias("mentions"))


def signal_counts(spark, folder):
    return reports.count_items(_blocks(spark, folder, "text").withColumn("s", S.signals(F.col("text"))), "s")


def block_flags(spark, folder):
    t = F.col("text")
    return _blocks(spark, folder, "text").select(*BLOCK, F.array_join(S.quality_flags(t), ",").alias("flags"), F.round(S.repetition_ratio(t), 6).alias("ratio"))


def _rows(spark, folder) -> DataFrame:
    columns, rows = tables.linear_table(F.col("text"))
    own = _blocks(spark, folder, "block_type", "text").where("block_type = 'table'").select(*BLOCK, columns.alias("columns"), rows.alias("rows"))
    return tables.exploded(own, BLOCK)


def table_rows(spark, folder):
    c, v = F.col("columns"), F.col("cells")
    return _rows(spark, folder).select(*BLOCK, "row_index", tables.cell(c, v, "Enzyme").alias("enzyme"), X.first_number(tables.cell(c, v, "Yield (%)")).alias("yield_pct"), tables.row_text(c, v).alias("line"), F.array_join(tables.row_flags(c, v), ",").alias("flags"))


def table_round_trip(spark, folder):
    """Tables written as text again; equal to what was read where nothing was lost."""
    columns, rows = tables.linear_table(F.col("text"))
    own = _blocks(spark, folder, "block_type", "text").where("block_type = 'table'").select(*BLOCK, tables.rows_to_text(columns, rows).alias("text"), F.size(rows).alias("n"))
    return own.where("n > 0").select(*BLOCK, "text")


_SAID = ("record_type", "source_id", "extracted", "confidence", "requires_review", "evidence_span")


def _metric_lines():
    return F.array_join(F.transform("metrics", lambda m: F.concat_ws(" ", m["name"], m["value"].cast("string"), m["unit"])), ",").alias("found")


def table_records(spark, folder):
    """Evidence records of the table rows."""
    made = evidence.records_from_tables(_table_records(spark, folder, _layout(spark, folder)))
    return made.select(*_SAID, _metric_lines(), F.array_join("review_reasons", ",").alias("reasons"))


def chunk_records(spark, folder):
    """Evidence records of the text candidates."""
    placed = _layout(spark, folder)
    made = evidence.records_from_candidates(_candidates(spark, folder, placed, _table_records(spark, folder, placed)))
    return made.select(*_SAID, _metric_lines(), F.array_join("quality_flags", ",").alias("flags"))


def _records(spark, folder, placed: DataFrame, made_tables: DataFrame, candidates: DataFrame) -> DataFrame:
    """All evidence records with their ids, each once: the first of those that agree in type, source, findings and metrics."""
    both = evidence.records_from_candidates(candidates).unionByName(evidence.records_from_tables(made_tables))
    return evidence.with_evidence_ids(both.dropDuplicates(["record_type", "source_id", "extracted", "metrics"]))


def _points(spark, folder, embedder=None) -> DataFrame:
    """The points of chunks, tables and evidence of the whole pipeline."""
    placed = _layout(spark, folder)
    made_tables = cut_lineage(_table_records(spark, folder, placed))
    made = cut_lineage(chunking.chunks(_full(spark, folder), placed))
    records = _records(spark, folder, placed, made_tables, chunking.extraction_candidates(made, made_tables))
    return index.points(made.unionByName(tables.chunks(made_tables), allowMissingColumns=True), made_tables, records, embedder)


def points_built(spark, folder):
    """Of every point what its payload says (evidence ids are hashes of canonical JSON, so records are named by their parent)."""
    made = _points(spark, folder)
    return made.select("point_type", F.coalesce("parent_source_id", "source_id").alias("source"), "record_type", "citation", "section", "requires_review", "usable_for_ranking", F.sha2("text", 256).alias("sha256"))


def retrieved(spark, folder):
    """The eight most similar usable points of every request, from the request's text to the hit (no SQL: hashed vectors)."""
    from lodestone.operators import search

    embedder = index.provider("hash_v1", dimensions=64)
    requests = table(spark, folder, "recommendation_inputs").dropDuplicates(["request_id"])
    asked = requests.select("request_id", X.recommendation_query(F.col("enzyme_name"), F.col("objective.primary"), F.col("application_context.substrate"), F.col("limits_given.available_materials").cast("string")).alias("query"))
    usable = _points(spark, folder, embedder).where("usable_for_ranking").select("id", "vector", "point_type", "source_id", "citation", "usable_for_ranking")
    hits = search.retrieve(cut_lineage(usable), asked, "request_id", "query", embedder, 8)
    return hits.select("request_id", "rank", "point_type", "source_id", "citation", F.round("score", 6).alias("score"))


def conditions_read(spark, folder):
    rows = _blocks(spark, folder, "text").withColumn("n", X.normalize_scientific(F.col("text")))
    c, who = evidence.conditions(F.col("n")), evidence.identity(F.col("n"))
    return rows.where("n IS NOT NULL").select(*BLOCK, c["pH"].alias("ph"), c["enzyme_loading"]["value"].alias("enzyme_loading"), c["immobilization_temperature"]["value"].alias("temperature"), who["enzyme_name"].alias("enzyme_name"))


def document_tokens(spark, folder):
    words = index.tokens(F.col("text"))
    rows = table(spark, folder, "documents", "doc_id", "text").select("doc_id", words.alias("w"))
    return rows.select("doc_id", F.size("w").alias("n_tokens"), F.size(F.array_distinct("w")).alias("n_distinct"), F.size(index.bigrams(F.col("w"))).alias("n_bigrams"))


def document_vectors(spark, folder):
    """Hashed vectors of all documents (no SQL: blake2b)."""
    rows = table(spark, folder, "documents", "doc_id", "text").select("doc_id", index.HashEmbedder(64).embed(F.col("text")).alias("vector"))
    return rows.select("doc_id", F.transform("vector", lambda x: F.round(x, 9)).alias("vector"))


QUERIES = {
    f.__name__: f
    for f in (text_normalized, text_scientific, text_spans, text_escaped, list_fallback, blocks_routed, page_boxes, section_titles, sections_carried, chunks_packed, chunks_merged, chunk_manifest, block_signals, signal_counts, block_flags, table_rows, table_round_trip, html_tables, table_full, table_records, candidates_built, chunk_records, points_built, retrieved, conditions_read, document_tokens, document_vectors)
}

_SPACE = X.SPACE
_B = "b AS (SELECT DISTINCT ON (document_id, block_index) * FROM text_blocks ORDER BY document_id, block_index, loaded_at)"
_STRIP = f"regexp_replace(%s, '^{_SPACE}+|{_SPACE}+$', '', 'g')"
_NORMAL = _STRIP % r"regexp_replace(regexp_replace(replace(text, chr(160), ' '), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"
_SPACED = f"trim(regexp_replace(%s, '{_SPACE}+', ' ', 'g'))"
_DEGREE = r"\^\s*\{\s*\\circ\s*\}\s*"
_SCIENTIFIC = rf"""regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(replace(text, '$', ' '),
    '(\d)\s+(\d)\s*\\?\s*{_DEGREE}C', '\1\2 C', 'g'), '(\d)\s+(\d)\s*~?\s*{_DEGREE}\\mathrm\s*\{{\s*C\s*\}}', '\1\2 C', 'g'), '{_SPACE}+', ' ', 'g'),
    '\ ^ {{ \circ }}', '°'), '^ {{ \circ }}', '°'), '(\d)\s+(\d\s*(?:°|C|mg|min|h|%))', '\1\2', 'g')"""
# RE2's word boundary is ASCII: letters beyond it are replaced by one before patterns with boundaries are matched.
_WORDY = r"regexp_replace(%s, '[\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2FF}\x{370}-\x{52F}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{1D400}-\x{1D7FF}]', 'q', 'g')"
_SIGNALS = "concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches({_WORDY % "coalesce(text, '')"}, '(?i){p}') THEN '{n}' END" for n, p in S.DOMAIN_PACK.items()) + ")"
_KEPT = "coalesce(block_type NOT IN ('header', 'footer', 'page_number'), TRUE)"
_TITLED = rf"""y AS (SELECT *, {_NORMAL} AS normal FROM b WHERE {_KEPT}),
    s AS (SELECT document_id, block_index, block_type, coalesce(page_idx, 0) AS page, CASE WHEN len(bbox) = 4 AND len(list_filter(bbox, lambda x: x IS NULL)) = 0 THEN bbox END AS box, normal AS text,
                 last_value(CASE WHEN regexp_matches(normal, '^\d+(?:\.\d+)*\.\s+\S+') THEN normal ELSE section END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY block_index) AS section FROM y)"""
_PACK = f"""{_TITLED},
    t AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY block_index) AS n FROM s WHERE block_type IN ('text', 'list', 'equation') AND text <> ''),
    r AS (SELECT document_id, n, block_index, section, page, text AS acc, block_index AS first_index, 1 AS n_blocks, page AS p0, page AS p1 FROM t WHERE n = 1
          UNION ALL
          SELECT t.document_id, t.n, t.block_index, t.section, t.page, CASE WHEN j.ok THEN r.acc || chr(10) || chr(10) || t.text ELSE t.text END, CASE WHEN j.ok THEN r.first_index ELSE t.block_index END,
                 CASE WHEN j.ok THEN r.n_blocks + 1 ELSE 1 END, CASE WHEN j.ok THEN least(r.p0, t.page) ELSE t.page END, CASE WHEN j.ok THEN greatest(r.p1, t.page) ELSE t.page END
          FROM r JOIN t ON t.document_id = r.document_id AND t.n = r.n + 1,
               LATERAL (SELECT length(r.acc) + 2 + length(t.text) <= 1200 AND t.section IS NOT DISTINCT FROM r.section AND t.page <= r.page + 1 AS ok) j),
    p AS (SELECT document_id, first_index, max(block_index) AS last_index, arg_max(acc, n) AS text, any_value(section) AS section, max(n_blocks) AS n_blocks, arg_max(p0, n) AS page_start, arg_max(p1, n) AS page_end FROM r GROUP BY 1, 2)"""
_MENTIONS = lambda text: f"list_sort(list_distinct(regexp_extract_all({_WORDY % text}, '(?i){S.NUMERIC}')))[:20]"
_ALL_SIGNALS = f"concat_ws(',', nullif({_SIGNALS}, ''), nullif(array_to_string(list_transform({_MENTIONS('text')}, lambda x: 'numeric:' || x), ','), ''))"
_FLAGGED = rf"""
    xt AS (SELECT DISTINCT text FROM (SELECT text FROM t UNION ALL SELECT text FROM p)),
    xw AS (SELECT text, regexp_extract_all(lower(text), '[a-z]{{4,}}') AS ws FROM xt),
    x AS (SELECT text, list_filter([CASE WHEN len(list_filter(regexp_extract_all(text, '\b(\d+(?:\.\d+)?)\s*%', 1), lambda v: CAST(v AS DOUBLE) > 300)) > 0 THEN 'suspicious_percent_gt_300' END,
                 CASE WHEN len(ws) >= 40 AND len(list_distinct(list_transform(generate_series(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1]))) / (len(ws) - 1) < 0.72 THEN 'possible_ocr_duplicate_text' END], lambda z: z IS NOT NULL) AS flags FROM xw)"""
_MERGE = f"""{_FLAGGED},
    a AS (SELECT *, length(text) < 80 AS short, {_SIGNALS} <> '' OR regexp_matches({_WORDY % 'text'}, '(?i){S.NUMERIC}') AS sig FROM p),
    c AS (SELECT *, sum(CASE WHEN NOT short OR sig THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY first_index) AS seen FROM a),
    d AS (SELECT *, sum(CASE WHEN NOT short OR (sig AND seen = 1) THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY first_index) AS g FROM c),
    mt AS (SELECT document_id, g, string_agg(text, chr(10) || chr(10) ORDER BY first_index) AS text, first(text ORDER BY first_index) AS text0,
                 first(section ORDER BY first_index) AS section, arg_min(page_start, first_index) AS page_start, max(page_end) AS page_end, CAST(sum(n_blocks) AS INTEGER) AS n_blocks, flatten(list(x.flags)) AS f1 FROM d JOIN x USING (text) WHERE g > 0 GROUP BY document_id, g),
    mb AS (SELECT d.document_id, d.g, string_agg(r.block_index, ',' ORDER BY r.block_index) AS source_block_indices, array_to_string(list_sort(list_distinct(list(t.block_type))), ',') AS block_types, flatten(list(x.flags)) AS f2,
                 CASE WHEN min(box[1]) IS NOT NULL THEN [min(box[1]), min(box[2]), max(box[3]), max(box[4])] END AS bbox
           FROM d JOIN r ON r.document_id = d.document_id AND r.first_index = d.first_index JOIN t ON t.document_id = r.document_id AND t.n = r.n JOIN x ON x.text = t.text WHERE g > 0 GROUP BY d.document_id, d.g),
    m AS (SELECT mt.*, CAST(g - 1 AS INTEGER) AS chunk_index, format('{{}}_chunk_{{:04d}}', document_id, CAST(g - 1 AS INTEGER)) AS chunk_id, source_block_indices, block_types, bbox, array_to_string(list_sort(list_distinct(list_concat(f1, f2))), ',') AS quality_flags, {_ALL_SIGNALS} AS signals FROM mt JOIN mb USING (document_id, g))"""
_ROUTE = f"CASE WHEN block_type IN ('header', 'footer', 'page_number') THEN 'skip' WHEN block_type IN ('text', 'list', 'equation') THEN CASE WHEN coalesce({_STRIP % 'text'}, '') <> '' THEN 'text' ELSE 'other' END WHEN block_type = 'table' THEN 'table' ELSE 'other' END"
_ROWS = r"""
    l AS (SELECT document_id, block_index, CASE WHEN text LIKE 'Columns: %' THEN string_split(text, chr(10)) ELSE []::VARCHAR[] END AS ls FROM b WHERE block_type = 'table'),
    x0 AS (SELECT document_id, block_index, CASE WHEN len(ls) > 0 THEN string_split(regexp_extract(ls[1], '^Columns: (.*)$', 1), ' | ') ELSE []::VARCHAR[] END AS cols, list_filter(ls, lambda z: regexp_matches(z, '^Row \d+: ')) AS rs FROM l),
    y0 AS (SELECT document_id, block_index, cols, unnest(rs) AS line, generate_subscripts(rs, 1) AS row_index FROM x0),
    z AS (SELECT document_id, block_index, cols, CAST(row_index AS INTEGER) AS row_index, string_split(regexp_replace(line, '^Row \d+: ', ''), '; ') AS ps FROM y0),
    w AS (SELECT *, list_transform(cols, lambda c: coalesce(regexp_replace(list_filter(ps, lambda q: regexp_extract(q, '^(.*?): ', 1) = c)[1], '^.*?: ', ''), '')) AS cells FROM z),
    v AS (SELECT *, cells[list_position(cols, 'Enzyme')] AS enzyme, TRY_CAST(nullif(regexp_extract(cells[list_position(cols, 'Yield (%)')], '\d+(?:\.\d+)?'), '') AS DOUBLE) AS yield_pct, cells[list_position(cols, 'References')] AS ref FROM w)"""
_TABLES = rf"""{_ROWS},
    ta AS (SELECT document_id, block_index, count(*) AS row_count, string_agg('Row ' || row_index || ': ' || array_to_string(list_transform(generate_series(1, len(cols)), lambda i: cols[i] || ': ' || cells[i]), '; '), chr(10) ORDER BY row_index) AS body,
                  bool_or(coalesce(len(list_filter(generate_series(1, len(cols)), lambda i: contains(lower(cols[i]), 'yield') AND contains(cols[i], '%') AND TRY_CAST(nullif(regexp_extract(cells[i], '\d+(?:\.\d+)?'), '') AS DOUBLE) > 100)) > 0, FALSE)) AS over,
                  bool_or(len(list_filter(generate_series(1, len(cols)), lambda i: contains(lower(cols[i]), 'reference') AND trim(cells[i]) NOT IN ('', 'This study') AND NOT starts_with(trim(cells[i]), '['))) > 0) AS bad FROM w GROUP BY 1, 2),
    tt AS (SELECT s.document_id, s.block_index, page, section, cols, format('{{}}_p{{}}_t{{}}', s.document_id, page, s.block_index) AS table_id, CAST(coalesce(row_count, 0) AS INTEGER) AS row_count,
                  concat_ws(chr(10), CASE WHEN len(cols) > 0 THEN 'Columns: ' || array_to_string(cols, ' | ') END, body) AS text,
                  concat_ws(',', CASE WHEN bad THEN 'suspicious_reference_cell' END, CASE WHEN over THEN 'suspicious_table_yield_gt_100' END, CASE WHEN len(cols) = 0 THEN 'table_parse_empty' END) AS flags,
                  row_number() OVER (PARTITION BY s.document_id ORDER BY s.block_index) - 1 AS number
           FROM s JOIN x0 ON x0.document_id = s.document_id AND x0.block_index = s.block_index LEFT JOIN ta ON ta.document_id = s.document_id AND ta.block_index = s.block_index)"""
_TABLE = f"{_TITLED}, {_TABLES}"
_TYPES = "concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches({_WORDY % 'text'}, '(?i){S.DOMAIN_PACK[n]}') THEN '{n}' END" for n in chunking.CANDIDATE_TYPES) + ")"
_CELLS = ", ".join(f"""'"{n}":' || CASE WHEN list_position(f.cols, '{c}') IS NULL THEN 'null' ELSE to_json(cells[list_position(f.cols, '{c}')]) END""" for n, c in (("enzyme_name", "Enzyme"), ("substrate", "Substrate"), ("operating_conditions", "Operating Conditions"), ("reaction_system", "System"), ("acyl_acceptor", "Acyl Acceptor"), ("reference", "References")))
_ROW_REF = "(ref IS NOT NULL AND ref <> '' AND ref <> 'This study' AND NOT starts_with(ref, '['))"

ORACLES = {
    "text_normalized": f"WITH {_B} SELECT document_id, block_index, sha256({_NORMAL}) AS normal, sha256({_SPACED % 'text'}) AS spaced, CAST(length({_STRIP % 'text'}) AS INTEGER) AS n_stripped, sha256(text) AS sha256 FROM b",
    "text_scientific": f"WITH {_B} SELECT document_id, block_index, {_SCIENTIFIC} AS scientific FROM b WHERE text IS NOT NULL",
    "text_spans": f"""WITH {_B}, a AS (SELECT *, strpos(lower(text), 'activity') - 1 AS p FROM b),
        s AS (SELECT document_id, block_index, CASE WHEN p < 0 THEN substr(text, 1, 420) ELSE substr(text, greatest(p - 140, 0) + 1, p + 420 - greatest(p - 140, 0)) END AS x FROM a)
        SELECT document_id, block_index, {_SPACED % 'x'} AS span FROM s WHERE {_SPACED % 'x'} <> ''""",
    "text_escaped": rf'''WITH {_B} SELECT document_id, block_index, replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n') AS escaped FROM b WHERE text IS NOT NULL''',
    "list_fallback": f"WITH {_B} SELECT document_id, block_index, CAST(length(CASE WHEN block_type = 'list' THEN coalesce(nullif(text, ''), section) ELSE text END) AS INTEGER) AS n_chars FROM b",
    "blocks_routed": f"WITH {_B} SELECT document_id, {_ROUTE} AS route, count(*) AS n FROM b GROUP BY ALL",
    "page_boxes": f"""WITH {_B}, v AS (SELECT document_id, page_idx, CASE WHEN len(bbox) = 4 AND len(list_filter(bbox, lambda x: x IS NULL)) = 0 THEN bbox END AS k FROM b)
        SELECT document_id, page_idx, CASE WHEN min(k[1]) IS NOT NULL THEN [min(k[1]), min(k[2]), max(k[3]), max(k[4])] END AS bbox FROM v GROUP BY 1, 2""",
    "section_titles": rf"WITH {_B} SELECT document_id, block_index, section AS title FROM b WHERE regexp_matches(section, '^\d+(?:\.\d+)*\.\s+\S+')",
    "sections_carried": f"WITH {_B}, {_TITLED} SELECT document_id, block_index, section AS carried FROM s",
    "chunks_packed": f"WITH RECURSIVE {_B}, {_PACK} SELECT document_id, first_index, last_index, n_blocks, section, page_start, page_end, sha256(text) AS sha256 FROM p",
    "chunks_merged": f"WITH RECURSIVE {_B}, {_PACK}, {_MERGE} SELECT chunk_id, document_id, document_id || '.pdf' AS source_pdf, chunk_index, section, page_start, page_end, bbox, n_blocks, sha256(text0) AS text_sha256, sha256(text) AS full_sha256, block_types, source_block_indices, signals, quality_flags FROM m",
    "chunk_manifest": f"""WITH RECURSIVE {_B}, {_PACK}, {_MERGE}, o AS (SELECT *, {_ROUTE} AS route FROM b), k AS (SELECT document_id, count(*) AS n_text_chunks, sum(length(text)) AS n_chars, count(*) FILTER ({_TYPES} <> '') AS n_typed FROM m GROUP BY 1)
        SELECT o.document_id, count(*) AS n_blocks, count(*) FILTER (route = 'skip') AS n_skipped, count(*) FILTER (route = 'text') AS n_text, count(DISTINCT page_idx) AS n_pages, count(*) FILTER (route = 'table') AS n_tables, CAST(coalesce(any_value(n_text_chunks), 0) AS BIGINT) AS n_text_chunks,
               count(*) FILTER (route = 'table') AS n_table_chunks, CAST(coalesce(any_value(n_text_chunks), 0) AS BIGINT) + count(*) FILTER (route = 'table') AS n_chunks, CAST(coalesce(any_value(n_typed), 0) AS BIGINT) + count(*) FILTER (route = 'table') AS n_candidates, CAST(coalesce(any_value(n_chars), 0) AS BIGINT) AS n_chars
        FROM o LEFT JOIN k ON k.document_id = o.document_id GROUP BY 1""",
    "block_signals": f"WITH {_B} SELECT document_id, block_index, {_SIGNALS} AS signals, array_to_string(list_sort(list_distinct(regexp_extract_all({_WORDY % "coalesce(text, '')"}, '(?i){S.NUMERIC}')))[:20], ',') AS mentions FROM b",
    "signal_counts": f"WITH {_B}, e AS (SELECT unnest(string_split({_SIGNALS}, ',')) AS key FROM b) SELECT key, count(*) AS n FROM e WHERE key <> '' GROUP BY 1",
    "block_flags": rf"""WITH {_B}, w AS (SELECT document_id, block_index, coalesce(text, '') AS text, regexp_extract_all(lower(coalesce(text, '')), '[a-z]{{4,}}') AS ws FROM b),
        q AS (SELECT *, CASE WHEN len(ws) >= 40 THEN len(list_distinct(list_transform(generate_series(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1]))) / (len(ws) - 1) END AS ratio,
                     len(list_filter(regexp_extract_all(text, '\b(\d+(?:\.\d+)?)\s*%', 1), lambda v: CAST(v AS DOUBLE) > 300)) > 0 AS over FROM w)
        SELECT document_id, block_index, concat_ws(',', CASE WHEN over THEN 'suspicious_percent_gt_300' END, CASE WHEN ratio < 0.72 THEN 'possible_ocr_duplicate_text' END) AS flags, round(ratio, 6) AS ratio FROM q""",
    "table_rows": f"""WITH {_B}, {_ROWS} SELECT document_id, block_index, row_index, enzyme, yield_pct, array_to_string(list_transform(list_filter(generate_series(1, len(cols)), lambda i: cells[i] <> ''), lambda i: cols[i] || ': ' || cells[i]), '; ') AS line,
        concat_ws(',', CASE WHEN coalesce(enzyme, '') = '' THEN 'missing_enzyme_cell' END, CASE WHEN {_ROW_REF} THEN 'suspicious_reference_cell' END, CASE WHEN yield_pct > 100 THEN 'suspicious_table_yield_gt_100' END) AS flags FROM v""",
    "table_round_trip": f"WITH {_B} SELECT document_id, block_index, text FROM b WHERE block_type = 'table' AND text LIKE 'Columns: %' AND text LIKE '%' || chr(10) || 'Row 1: %'",
    "html_tables": f"""WITH {_B}, {_ROWS} SELECT document_id, block_index, 0 AS row_index, array_to_string(cols, '|') AS cells FROM x0 WHERE len(cols) > 0
        UNION ALL SELECT document_id, block_index, CAST(row_index AS INTEGER), array_to_string(cells, '|') FROM w WHERE len(list_filter(cells, lambda c: c <> '')) > 0""",
    "table_full": f"""WITH {_B}, {_TABLE} SELECT table_id, format('{{}}_table_chunk_{{:04d}}', document_id, number) AS chunk_id, block_index AS source_block_index, page AS page_idx, section, array_to_string(cols, '|') AS columns, row_count,
        sha256(text) AS sha256, CAST(length(text) AS INTEGER) AS n_chars, {_ALL_SIGNALS} AS signals, flags FROM tt""",
    "candidates_built": f"""WITH RECURSIVE {_B}, {_PACK}, {_MERGE}, {_TABLES}
        SELECT 'cand_' || chunk_id AS candidate_id, 'rag_chunk' AS candidate_source, chunk_id AS source_id, section, page_start, page_end, {_TYPES} AS types, sha256(text) AS sha256, quality_flags AS flags FROM m WHERE {_TYPES} <> ''
        UNION ALL SELECT 'cand_' || table_id, 'table_record', table_id, section, page, page, array_to_string(list_sort(list_distinct(list_concat(string_split({_TYPES}, ','), ['table_metric']))), ','), sha256(text), flags FROM tt""",
    "table_records": f"""WITH {_B}, {_TABLE}, f AS (SELECT *, coalesce(enzyme, '') = '' OR {_ROW_REF} OR coalesce(yield_pct > 100, FALSE) AS flagged FROM v)
        SELECT 'table_comparison_row' AS record_type, table_id AS source_id, '{{' || concat_ws(',', {_CELLS}, '"table_id":"' || table_id || '"', '"row_index":' || row_index) || '}}' AS extracted,
               CASE WHEN flagged THEN 'low' ELSE 'medium' END AS confidence, flagged AS requires_review, array_to_string(list_transform(list_filter(generate_series(1, len(f.cols)), lambda i: cells[i] <> ''), lambda i: f.cols[i] || ': ' || cells[i]), '; ') AS evidence_span,
               coalesce('biodiesel_yield ' || yield_pct || ' %', '') AS found, concat_ws(',', CASE WHEN {_ROW_REF} THEN 'malformed_reference' END, CASE WHEN yield_pct > 100 THEN 'metric_percent_gt_100' END, CASE WHEN flagged THEN 'upstream_quality_flags' END) AS reasons
        FROM f JOIN tt ON tt.document_id = f.document_id AND tt.block_index = f.block_index""",
    "conditions_read": rf"""WITH {_B}, n AS (SELECT document_id, block_index, {_WORDY % _SCIENTIFIC} AS n FROM b WHERE text IS NOT NULL),
        t AS (SELECT *, list_filter(list_transform(regexp_extract_all(n, '\b(\d+(?:\.\d+)?)\s*(?:°C|\^\s*\{{\s*\\circ\s*\}}\s*C|C)\b', 1), lambda v: CAST(v AS DOUBLE)), lambda v: v BETWEEN 10 AND 80) AS ts FROM n)
        SELECT document_id, block_index, TRY_CAST(list_last(regexp_extract_all(n, '(?i)\bpH(?:\s+value)?\s*(?:was|of|=|at|to)?\s*(\d+(?:\.\d+)?)', 1)) AS DOUBLE) AS ph,
               TRY_CAST(list_last(regexp_extract_all(n, '(?i)\b(?:BCL[-\s\w]*?)?loading(?:\s+of)?\s*(\d+(?:\.\d+)?)\s*mg\b', 1)) AS DOUBLE) AS enzyme_loading, CASE WHEN list_contains(ts, 25) THEN 25.0 ELSE ts[1] END AS temperature,
               CASE WHEN regexp_matches(n, '(?i)Burkholderia\s+cepacia\s+lipase') OR regexp_matches(n, '\bBCL\b') THEN 'Burkholderia cepacia lipase' WHEN regexp_matches(n, '(?i)\blipase\b') THEN 'lipase' END AS enzyme_name FROM t""",
    "document_tokens": rf"""WITH k AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '{index.TOKEN}'), lambda t: regexp_replace(lower(t), '^-+|-+$', '', 'g')), lambda t: t <> '') AS w FROM documents),
        e AS (SELECT doc_id, flatten(list_transform(w, lambda t: list_concat([t], CASE t {' '.join(f"WHEN '{a}' THEN {b!r}" for a, b in index.ALIASES.items())} ELSE []::VARCHAR[] END))) AS w FROM k)
        SELECT doc_id, CAST(len(w) AS INTEGER) AS n_tokens, CAST(len(list_distinct(w)) AS INTEGER) AS n_distinct, CAST(greatest(len(w) - 1, 0) AS INTEGER) AS n_bigrams FROM e""",
}

"""Rule-based evidence records from texts and table rows."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import signals as S
from lodestone.functions import text as X
from lodestone.operators import tables as H

# How conditions and metrics are written; group 1 is the value.
PH = r"(?i)\bpH(?:\s+value)?\s*(?:was|of|=|at|to)?\s*(\d+(?:\.\d+)?)"
LOADING = r"(?i)\b(?:BCL[-\s\w]*?)?loading(?:\s+of)?\s*(\d+(?:\.\d+)?)\s*mg\b"
ADSORPTION_TIME = r"(?i)\badsorption time\s*(\d+(?:\.\d+)?)\s*min\b"
TEMPERATURE = r"\b(\d+(?:\.\d+)?)\s*(?:°C|\^\s*\{\s*\\circ\s*\}\s*C|C)\b"
BIODIESEL_YIELD = r"(?i)\bbiodiesel(?:\s+\w+){0,4}?\s+(?:with|of|was|reached)?\s*(\d+(?:\.\d+)?)\s*%\s+yield\b"
REUSE = r"(?i)\b(?:reused|reuse|reusability).*?(\d+|one|two|three|four|five|six|seven|eight|nine|ten)\s+cycles?\b"
ACTIVITY_RECOVERY = r"(?i)\bactivity recovery(?:\s+\w+){0,8}?\s*(?:up to|of|was|reached|value of)?\s*(\d+(?:\.\d+)?)\s*%"
ROW_REUSE = r"(?i)(\d+)\s*cycle\s*;\s*(\d+(?:\.\d+)?)"


def identity(text: Column) -> Column:
    """The enzyme a text names: enzyme_name, enzyme_abbreviation, ec_number (null where not given)."""
    full, short = text.rlike(r"(?i)Burkholderia\s+cepacia\s+lipase"), text.rlike(r"\bBCL\b")
    return F.struct(
        F.when(full | short, "Burkholderia cepacia lipase").when(text.rlike(r"(?i)\blipase\b"), "lipase").alias("enzyme_name"),
        F.when(short, "BCL").alias("enzyme_abbreviation"),
        F.when(full & text.rlike(r"(?i)E\.?C\.?\s*3\.1\.1\.3"), "3.1.1.3").alias("ec_number"),
    )


def strategy(text: Column) -> Column:
    """Carrier, variant, class, method and product that a text names."""
    framework = text.rlike(r"(?i)\bZIF-8\b")
    return F.struct(
        F.when(framework, "ZIF-8").alias("carrier"),
        F.when(framework & text.rlike(r"(?i)hierarchical\s+ZIF-8|hierarchical\s+mesoporous"), "hierarchical mesoporous ZIF-8").alias("carrier_variant"),
        F.when(framework, "MOF").alias("material_class"),
        F.when(text.rlike(r"(?i)\badsorption\b"), "adsorption").alias("immobilization_method"),
        F.when(text.rlike(r"\bBCL-ZIF-8\b"), "BCL-ZIF-8").alias("immobilized_product"),
    )


def _quantity(value: Column, unit: str) -> Column:
    """A value with its unit; null without a value."""
    return F.when(value.isNotNull(), F.struct(value.alias("value"), F.lit(unit).alias("unit")))


def conditions(text: Column) -> Column:
    """Loading (last, mg), adsorption time (first, min), pH (last) and temperature (degC) of a normalised text."""
    return F.struct(
        _quantity(X.last_match(text, LOADING), "mg").alias("enzyme_loading"),
        _quantity(X.first_match(text, ADSORPTION_TIME), "min").alias("adsorption_time"),
        X.last_match(text, PH).alias("pH"),
        _quantity(X.select_temperature(X.matched_numbers(text, TEMPERATURE)), "degC").alias("immobilization_temperature"),
    )


def _metric(name: str, value: Column, unit: str, raw: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), value.cast("double").alias("value"), F.lit(unit).alias("unit"), F.lit(None).cast("int").alias("cycle"), raw.cast("string").alias("raw"))


def metrics(text: Column) -> Column:
    """All activity recoveries, the first biodiesel yield and the first number of reuse cycles; repeated ones once."""
    recoveries = F.arrays_zip(X.matched_numbers(text, ACTIVITY_RECOVERY).alias("v"), F.regexp_extract_all(text, F.lit(ACTIVITY_RECOVERY), 0).alias("r"))
    every = F.transform(recoveries, lambda m: _metric("activity_recovery", m["v"], "%", m["r"]))
    produced = X.let(X.first_match(text, BIODIESEL_YIELD), lambda v: F.when(v.isNotNull(), _metric("biodiesel_yield", v, "%", F.concat(v.cast("string"), F.lit("%")))))
    reuse = lambda group: F.get(F.regexp_extract_all(text, F.lit(REUSE), group), F.lit(0))
    cycles = X.let(X.let(reuse(1), X.cycle_count), lambda n: F.when(n.isNotNull(), _metric("reuse_cycles", n, "cycle", reuse(0))))
    more = F.array(produced, cycles)
    return distinct_metrics(F.concat(every, F.array_compact(more)))


def distinct_metrics(column: Column) -> Column:
    """The first of the metrics with the same name, value, unit and cycle, in order."""
    same = lambda a, b: a["name"].eqNullSafe(b["name"]) & a["value"].eqNullSafe(b["value"]) & a["unit"].eqNullSafe(b["unit"]) & a["cycle"].eqNullSafe(b["cycle"])
    return X.let(column, lambda c: F.aggregate(F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, F.lit(1), F.lit(1)), lambda kept, m: F.when(F.exists(kept, lambda k: same(k, m)), kept).otherwise(F.concat(kept, F.array(m)))))


#: The columns of an evidence record, without its id.
RECORD = ["record_type", "candidate_source", "document_id", "source_pdf", "source_id", "source_block_indices", "page_start", "page_end", "bbox", "section", "evidence_span", "extracted", "metrics", "confidence", "quality_flags", "review_reasons", "requires_review"]


def _judged(found: DataFrame, reference: Column) -> DataFrame:
    """The records with what follows from their flags, metrics and reference."""
    reasons = S.review_reasons(F.col("quality_flags"), F.col("metrics"), reference)
    return found.withColumns({"evidence_span": F.substring("evidence_span", 1, 1500), "review_reasons": reasons, "requires_review": F.size(reasons) > 0, "confidence": S.confidence(F.col("quality_flags"))}).select(*RECORD)


def records_from_candidates(candidates: DataFrame) -> DataFrame:
    """Up to four records (:data:`RECORD`) of each text candidate of :func:`chunking.extraction_candidates`: one a type with findings.

    Tables are left out here (see :func:`records_from_tables`); null texts give none. ``extracted`` is
    JSON without null fields.
    """
    read = candidates.where((F.col("candidate_source") == "rag_chunk") & F.col("text").isNotNull()).withColumn("_n", X.normalize_scientific(F.col("text")))
    read = read.withColumns({"_identity": identity(F.col("_n")), "_strategy": strategy(F.col("_n")), "_conditions": conditions(F.col("_n")), "_metrics": metrics(F.col("_n"))})
    some = lambda s: F.to_json(s) != "{}"
    none = F.array().cast(read.schema["_metrics"].dataType)
    option = lambda kind, there, fields, found, anchor: F.when(there, F.struct(F.lit(kind).alias("record_type"), fields.alias("extracted"), found.alias("metrics"), X.select_span(F.col("text"), anchor).alias("evidence_span")))
    options = F.array(
        option("enzyme_identity", F.col("_identity.enzyme_name").isNotNull(), F.to_json("_identity"), none, "lipase"),
        option("immobilization_strategy", some("_strategy"), F.to_json("_strategy"), none, "ZIF-8"),
        option("formulation_condition", some("_conditions"), F.to_json("_conditions"), none, "optimal conditions"),
        option("performance_metric", F.size("_metrics") > 0, F.lit("{}"), F.col("_metrics"), "activity recovery"),
    )
    each = read.drop("metrics", "extracted", "evidence_span", "record_type").withColumn("_r", F.explode(F.array_compact(options))).select("*", "_r.*")
    return _judged(each.withColumn("quality_flags", F.array_sort(F.array_distinct("quality_flags"))), F.lit(None).cast("string"))


def records_from_tables(made: DataFrame) -> DataFrame:
    """One record (:data:`RECORD`) of each row of :func:`tables.records`, however empty; ``extracted`` keeps its null fields.

    The flags of the table don't count, those of the row do.
    """
    rows = H.exploded(made, ["table_id", "document_id", "source_pdf", "source_block_index", "page_idx", "bbox", "section"])
    columns, cells = F.col("columns"), F.col("cells")
    value = lambda name: H.cell(columns, cells, name)
    extracted = F.to_json(
        F.struct(
            value("Enzyme").alias("enzyme_name"), value("Substrate").alias("substrate"), value("Operating Conditions").alias("operating_conditions"), value("System").alias("reaction_system"), value("Acyl Acceptor").alias("acyl_acceptor"), value("References").alias("reference"), F.col("table_id").alias("table_id"),
            F.col("row_index").alias("row_index"),
        ),
        {"ignoreNullFields": "false"},
    )
    reuse = value("Reusability and Last Yield (%)")
    part = lambda group: F.nullif(F.regexp_extract(reuse, ROW_REUSE, group), F.lit(""))
    found = F.array(
        F.when(X.first_number(value("Yield (%)")).isNotNull(), _metric("biodiesel_yield", X.first_number(value("Yield (%)")), "%", value("Yield (%)"))),
        F.when(reuse.rlike(ROW_REUSE), F.struct(F.lit("reusability_last_yield").alias("name"), part(2).cast("double").alias("value"), F.lit("%").alias("unit"), part(1).cast("int").alias("cycle"), reuse.alias("raw"))),
    )
    each = rows.select(
        F.lit("table_comparison_row").alias("record_type"), F.lit("table_record").alias("candidate_source"), "document_id", "source_pdf", F.col("table_id").alias("source_id"), F.array("source_block_index").alias("source_block_indices"), F.col("page_idx").alias("page_start"), F.col("page_idx").alias("page_end"), "bbox", "section",
        X.normalize_space(H.row_text(columns, cells)).alias("evidence_span"), extracted.alias("extracted"), F.array_compact(found).alias("metrics"), H.row_flags(columns, cells).alias("quality_flags"), value("References").alias("_reference"),
    )
    return _judged(each, F.col("_reference"))


def canonical(text: str | None) -> str | None:
    """JSON with sorted keys, ", " and ": ", nulls kept; texts that are no JSON as they are."""
    try:
        return json.dumps(json.loads(text), sort_keys=True, ensure_ascii=False) if text is not None else None
    except ValueError:
        return text


def canonical_json(column: Column) -> Column:
    """:func:`canonical` of a JSON column."""

    @F.pandas_udf("string")
    def made(values: pd.Series) -> pd.Series:
        return values.map(canonical)

    return made(column)


def evidence_id(record_type: str, source_id: str, extracted: dict, found: list, span: str) -> str:
    """The content-hash id of a record."""
    payload = {"record_type": record_type, "source_id": source_id, "extracted": extracted, "metrics": found, "span": span}
    return "ev_" + hashlib.sha1(json.dumps(payload, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]


def with_evidence_ids(records: DataFrame) -> DataFrame:
    """``records`` with evidence_id by :func:`evidence_id` (metrics without their null fields)."""

    def listed(text: str | None) -> list:
        found = json.loads(text) if text else []
        for m in found:
            if m and m.get("name") == "reuse_cycles" and m.get("value") is not None:  # counts are whole numbers
                m["value"] = int(m["value"])
        return found

    @F.pandas_udf("string")
    def made(kind: pd.Series, source: pd.Series, extracted: pd.Series, found: pd.Series, span: pd.Series) -> pd.Series:
        return pd.Series([evidence_id(k, s, json.loads(e) if e else {}, listed(m), p) for k, s, e, m, p in zip(kind, source, extracted, found, span)])

    return records.withColumn("evidence_id", made("record_type", "source_id", "extracted", F.to_json("metrics"), "evidence_span"))


def first_of_equal(records: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row, by ``order``, of the rows that agree in ``keys`` (nulls agree)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return records.withColumn("_rank", rank).where("_rank = 1").drop("_rank")

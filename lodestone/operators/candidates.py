"""Candidates of an answer: from a generated text where its references hold, else from the evidence; and what stands beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import search

# The keys of findings that are no conditions, the parts of a candidate, and the records that tell a strategy.
NOT_CONDITIONS = ("carrier", "carrier_variant", "immobilization_method", "material_class")
PARTS = ("rank", "strategy_summary", "carrier", "immobilization_method", "recommended_conditions", "expected_benefits", "risks", "evidence_ids", "citations", "confidence")
STRATEGIES = ("immobilization_strategy", "table_comparison_row", "formulation_condition")
MOST = 3
# Limitations and experiments that follow from the evidence.
NO_EVIDENCE, TO_REVIEW = "no usable evidence was retrieved", "some retrieved evidence requires review and should not be used for ranking"
NO_CHANGES, NO_OPTIMUM = "no field-level changes were generated from the current evidence", "recommendations are evidence-based starting points, not a global optimum without DOE validation"
EXPERIMENT = ("enzyme_loading / carrier_amount / pH / temperature / time", "activity recovery, biodiesel yield, residual activity after reuse")
CHANGE_METRIC, CHANGE_VARIABLES = "activity recovery, immobilization yield, product yield, residual activity after reuse", ("enzyme.amount", "carrier", "buffer.pH", "immobilization_conditions.temperature")

CANDIDATE = ["group_id", "rank", "origin", "strategy_summary", "carrier", "immobilization_method", "recommended_conditions", "expected_benefits", "risks", "evidence_ids", "citations", "confidence"]


def _texts(items: Column | None = None) -> Column:
    empty = F.array().cast("array<string>")
    return empty if items is None else F.coalesce(items, empty)


def merged(primary: Column, fallback: Column) -> Column:
    """Two maps as one; the keys of ``primary`` win, null values included; null maps count as empty."""
    empty = F.create_map().cast("map<string,string>")
    rest = F.map_filter(F.coalesce(fallback, empty), lambda k, v: ~F.array_contains(F.map_keys(F.coalesce(primary, empty)), k))
    return F.map_concat(F.coalesce(primary, empty), rest)


def conditions_of(extracted: Column) -> Column:
    """The findings that are conditions."""
    return F.map_filter(extracted, lambda k, v: ~k.isin(*NOT_CONDITIONS))


def benefits(metrics: Column) -> Column:
    """``name: value`` and the unit of each metric with a name and a value, in order."""
    number = lambda v: F.regexp_replace(v.cast("decimal(30,8)").cast("string"), r"(\.\d+?)0+$", "$1")
    told = F.filter(metrics, lambda m: (F.coalesce(m["name"], F.lit("")) != "") & m["value"].isNotNull())
    return _texts(F.transform(told, lambda m: F.concat(m["name"], F.lit(": "), number(m["value"]), F.coalesce(m["unit"], F.lit("")))))


def limitations(generated: Column, n_hits: Column, any_review: Column) -> Column:
    """Generated limitations and those that follow from the hits, each once, in order."""
    return F.array_distinct(F.concat(X.plain_items(generated), F.array_compact(F.array(F.when(n_hits == 0, F.lit(NO_EVIDENCE)), F.when(any_review, F.lit(TO_REVIEW))))))


def change_limitations(generated: Column, n_hits: Column, any_review: Column, n_changes: Column) -> Column:
    """:func:`limitations` of a list of changes."""
    more = F.array(F.when(n_hits == 0, F.lit(NO_EVIDENCE)), F.when(n_changes == 0, F.lit(NO_CHANGES)), F.when(any_review, F.lit(TO_REVIEW)), F.lit(NO_OPTIMUM))
    return F.array_distinct(F.concat(X.plain_items(generated), F.array_compact(more)))


def generated_experiments(answer: Column) -> Column:
    """The experiments that an answer suggests, as JSON: objects as they are, texts as the one field ``suggestion``."""
    listed = F.from_json(F.get_json_object(answer, "$.next_experiment_suggestions"), "array<string>")
    one = lambda e: F.when(e.startswith("{"), e).when(X.strip(e) != "", F.to_json(F.struct(X.strip(e).alias("suggestion"))))
    return F.array_compact(F.transform(_texts(listed), one))


def experiments(answer: Column, citations: Column, n_hits: Column) -> Column:
    """Generated experiments, else one that varies the usual settings, with the citations of the first three hits; none without hits."""
    made, basis = generated_experiments(answer), F.array_compact(F.slice(_texts(citations), 1, 3))
    usual = F.to_json(F.struct(F.lit(EXPERIMENT[0]).alias("variable"), F.lit(EXPERIMENT[1]).alias("metric"), basis.alias("evidence_basis")))
    return F.when(F.size(made) > 0, made).when(n_hits > 0, F.array(usual)).otherwise(_texts())


def change_experiments(answer: Column, citations: Column, places: Column) -> Column:
    """Generated experiments, else one that varies the first four changed places, or the usual ones."""
    made, basis = generated_experiments(answer), F.array_compact(F.slice(_texts(citations), 1, 3))
    variables = F.when(F.size(_texts(places)) > 0, F.slice(places, 1, 4)).otherwise(F.array(*[F.lit(v) for v in CHANGE_VARIABLES]))
    return F.when(F.size(made) > 0, made).otherwise(F.array(F.to_json(F.struct(variables.alias("variables"), F.lit(CHANGE_METRIC).alias("metric"), basis.alias("evidence_basis")))))


def answer_id(name: Column, objective: Column, source_ids: Column, formulation: Column | None = None) -> Column:
    """The stable id of an answer: of its enzyme, objective, formulation (canonical JSON) if any, and first five sources."""
    parts = [name, objective, *([] if formulation is None else [formulation]), F.array_join(F.slice(source_ids, 1, 5), ",")]
    return F.concat(F.lit("rec_" if formulation is None else "opt_"), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 12))


def from_generated(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """Candidates of ``answers`` (group_id, candidates: a JSON list) of which some reference is one of the group's ``hits``.

    A single object counts as a list of one; malformed JSON and nulls as empty. A candidate with other
    keys than those of :data:`PARTS`, or a rank, text or list of the wrong kind, is dropped. Unknown
    confidences become medium; references that no hit answers are dropped, and candidates without any left.
    """
    each = search.elements(answers, "candidates", None, PARTS)
    kind = search.kind_of
    optional = lambda name, *allowed: kind(name).isNull() | kind(name).isin("VOID", *allowed)
    listed = lambda name: kind(name).isNull() | kind(name).isin("ARRAY<STRING>", "ARRAY<VOID>")
    fit = (kind("strategy_summary") == "STRING") & search.text_of("rank").try_cast("int").isNotNull() & optional("carrier", "STRING") & optional("immobilization_method", "STRING") & listed("expected_benefits") & listed("risks") & (kind("recommended_conditions").isNull() | kind("recommended_conditions").startswith("OBJECT"))
    kept = search.resolved(each.where(F.coalesce(fit, F.lit(False))), hits)
    items = lambda name: _texts(F.try_variant_get("v", f"$.{name}", "array<string>"))
    conditions = F.from_json(F.to_json(F.try_variant_get("v", "$.recommended_conditions", "variant")), "map<string,string>")
    return kept.select("group_id", search.text_of("rank").try_cast("int").alias("rank"), F.lit("generated").alias("origin"), search.text_of("strategy_summary").alias("strategy_summary"), search.text_of("carrier").alias("carrier"), search.text_of("immobilization_method").alias("immobilization_method"), merged(conditions, F.lit(None).cast("map<string,string>")).alias("recommended_conditions"), items("expected_benefits").alias("expected_benefits"), items("risks").alias("risks"), "evidence_ids", "citations", search.confidence_of().alias("confidence"))


def from_evidence(hits: DataFrame, most: int = MOST) -> DataFrame:
    """The first ``most`` hits of each group (a bounded top-k) that tell a strategy; if none does, the first hit.

    ``hits``: group_id, rank, source_id, citation, record_type, extracted (map), metrics, confidence,
    text. The conditions are those of the hit and of the group's first condition record.
    """
    e = lambda key: F.nullif(F.try_element_at("extracted", F.lit(key)), F.lit(""))
    carrier, variant, method = e("carrier"), e("carrier_variant"), e("immobilization_method")
    row = F.col("record_type") == "table_comparison_row"
    fits = F.coalesce(F.col("record_type").isin(*STRATEGIES) & (carrier.isNotNull() | variant.isNotNull() | method.isNotNull() | row), F.lit(False))
    of_row = F.concat(F.coalesce(e("enzyme_name"), F.lit("enzyme")), F.lit(" in "), F.coalesce(e("substrate"), F.lit("substrate")), F.lit(" system with "), F.coalesce(e("acyl_acceptor"), F.lit("acyl acceptor")))
    named, text = F.coalesce(variant, carrier), F.coalesce("text", F.lit(""))
    summary = F.when(row, of_row).when(named.isNotNull() & method.isNotNull(), F.concat(method, F.lit(" on "), named)).otherwise(F.substring(text, 1, 180))
    group = Window.partitionBy("group_id")
    first = F.first(F.when((F.col("record_type") == "formulation_condition") & (F.size("extracted") > 0), F.col("extracted")), True).over(group.orderBy("rank", "source_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    marked = hits.withColumns({"_fits": fits, "_any": F.max(fits).over(group), "_first": first})
    placed = marked.withColumn("_n", F.row_number().over(group.orderBy(F.col("_fits").desc(), "rank", "source_id")))
    kept = placed.where(F.when(F.col("_any"), F.col("_fits") & (F.col("_n") <= most)).otherwise(F.col("_n") == 1))
    fit = F.col("_fits")
    return kept.select(
        "group_id", F.col("_n").alias("rank"), F.when(fit, "evidence").otherwise("fallback").alias("origin"), F.when(fit, summary).otherwise(F.coalesce(F.nullif(F.substring(text, 1, 300), F.lit("")), F.lit("retrieved evidence"))).alias("strategy_summary"), F.when(fit, F.coalesce(carrier, variant)).alias("carrier"),
        F.when(fit, method).alias("immobilization_method"), merged(F.when(fit, conditions_of(F.col("extracted"))), F.col("_first")).alias("recommended_conditions"), benefits(F.col("metrics")).alias("expected_benefits"), _texts().alias("risks"), F.array("source_id").alias("evidence_ids"),
        F.array_compact(F.array(F.nullif("citation", F.lit("")))).alias("citations"), F.coalesce(F.nullif("confidence", F.lit("")), F.when(fit, "medium").otherwise("low")).alias("confidence"),
    )


def candidates(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """The generated candidates of each group, or those from evidence if no generated one holds."""
    made = from_generated(answers, hits).select(*CANDIDATE)
    return made.unionByName(from_evidence(hits).join(made.select("group_id").distinct(), "group_id", "left_anti").select(*CANDIDATE))

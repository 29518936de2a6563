"""Signals, mentions and quality flags of texts. Patterns are data: a pack is a dict of name -> pattern."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import text as X

# The domain's signal families, matched without case.
DOMAIN_PACK = {
    "enzyme_identity": r"\b(lipase|enzyme|BCL|Burkholderia\s+cepacia|Candida|Novozym|Pseudomonas)\b",
    "immobilization_strategy": r"\b(immobili[sz]ation|immobilized|adsorption|covalent|carrier|support|ZIF-8|MOF|metal[- ]organic framework)\b",
    "formulation_condition": r"\b(loading|adsorption time|temperature|pH|buffer|mg|mM|min|hour|h|wt\s*%|°C|\\circ)\b",
    "performance_metric": r"\b(activity recovery|immobili[sz]ation efficiency|yield|reusability|reuse|cycle|stability|specific activity|biodiesel yield)\b",
    "application_context": r"\b(biodiesel|transesterification|esterification|substrate|methanol|oil|reaction system)\b",
}
# Fixed value: numbers with a unit.
NUMERIC = r"\b\d+(?:\.\d+)?\s*(?:%|mg|g|mM|M|min|h|hour|hours|cycle|cycles|wt\s*%|°C|C)\b"


def signals(text: Column, pack: dict[str, str] | None = None) -> Column:
    """The names of the families of ``pack`` that ``text`` matches, in the pack's order; empty for null."""
    found = [F.when(F.coalesce(text, F.lit("")).rlike(f"(?i){pattern}"), F.lit(name)) for name, pattern in (pack or DOMAIN_PACK).items()]
    return F.array_compact(F.array(*found))


def numeric_mentions(text: Column, most: int = 20) -> Column:
    """The first ``most`` distinct numbers with a unit, sorted."""
    return F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?i){NUMERIC}"), 0))), 1, most)


def all_signals(text: Column, pack: dict[str, str] | None = None) -> Column:
    """The families of ``text``, then its numeric mentions as ``numeric:`` and the mention."""
    return F.concat(signals(text, pack), F.transform(numeric_mentions(text), lambda m: F.concat(F.lit("numeric:"), m)))


def percent_over(text: Column, limit: float = 300) -> Column:
    """Whether some percentage in ``text`` is above ``limit``."""
    return F.exists(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b(\d+(?:\.\d+)?)\s*%"), 1), lambda x: x.cast("double")), lambda v: v > limit)


def repetition_ratio(text: Column) -> Column:
    """Distinct share of the pairs of neighbouring words (four ASCII letters or more); null under 40 words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z]{4,}"), 0)
    pairs = lambda w: F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))
    return X.let(words, lambda w: F.when(F.size(w) >= 40, F.size(F.array_distinct(pairs(w))) / (F.size(w) - 1)))


def quality_flags(text: Column) -> Column:
    """Flags of a text: a percentage above 300, likely repetition from recognition."""
    return F.array_compact(F.array(F.when(percent_over(text), F.lit("suspicious_percent_gt_300")), F.when(repetition_ratio(text) < 0.72, F.lit("possible_ocr_duplicate_text"))))


def malformed_reference(reference: Column) -> Column:
    """Whether a reference is neither empty, nor this study, nor a bracketed number."""
    return F.coalesce((reference != "") & (reference != "This study") & ~reference.startswith("["), F.lit(False))


def review_reasons(flags: Column, metrics: Column, reference: Column) -> Column:
    """Sorted reasons to review a record: flags, a percentage over 100, a metric without unit, a malformed reference."""
    over = F.exists(metrics, lambda m: m["name"].isin("activity_recovery", "biodiesel_yield") & F.coalesce(m["value"] > 100, F.lit(False)))
    bare = F.exists(metrics, lambda m: m["unit"].isNull())
    return F.array_compact(
        F.array(F.when(malformed_reference(reference), F.lit("malformed_reference")), F.when(bare, F.lit("metric_missing_unit")), F.when(over, F.lit("metric_percent_gt_100")), F.when(F.size(flags) > 0, F.lit("upstream_quality_flags")))
    )


def confidence(flags: Column) -> Column:
    return F.when(F.size(flags) > 0, "low").otherwise("medium")

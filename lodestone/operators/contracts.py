"""Checks of the record contracts: each is a predicate column that holds for a valid row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The allowed values.
CONFIDENCES, POINTS = ("low", "medium", "high"), ("rag_chunk", "table_record", "evidence_record")
RECORDS = ("enzyme_identity", "immobilization_strategy", "formulation_condition", "performance_metric", "table_comparison_row", "application_context")


def unit_given(metrics: Column) -> Column:
    """Every metric with a value has a unit."""
    return ~F.coalesce(F.exists(metrics, lambda m: m["value"].isNotNull() & m["unit"].isNull()), F.lit(False))


def some_metric(metrics: Column) -> Column:
    return F.coalesce(F.exists(metrics, lambda m: m["value"].isNotNull()), F.lit(False))


def span_given(span: Column) -> Column:
    from lodestone.functions.text import strip

    return F.coalesce(strip(span) != "", F.lit(False))


def one_of(value: Column, allowed: tuple[str, ...]) -> Column:
    return F.coalesce(value.isin(*allowed), F.lit(False))


def pages_ordered(start: Column, end: Column) -> Column:
    return start.isNull() | end.isNull() | (start <= end)


def answer_shape(kind: Column, n_candidates: Column, reason: Column) -> Column:
    """Ranked answers have candidates, abstentions a reason."""
    return F.when(kind == "ranked_candidates", n_candidates > 0).when(kind == "abstention", F.coalesce(reason != "", F.lit(False))).otherwise(True)


def confidence_in_range(value: Column) -> Column:
    """A confidence given as a number is from 0 to 1."""
    return F.coalesce((value >= 0) & (value <= 1), F.lit(False))


def ranked(rank: Column, evidence_ids: Column) -> Column:
    """A candidate has a rank from 1 and at least one evidence id."""
    return F.coalesce((rank >= 1) & (F.size(evidence_ids) > 0), F.lit(False))


def linked(**pairs: tuple[Column, Column]) -> list[Column]:
    """For each name whether its two ids are the same, as the parts of one record must name each other."""
    return [F.coalesce(a == b, F.lit(False)).alias(name) for name, (a, b) in pairs.items()]

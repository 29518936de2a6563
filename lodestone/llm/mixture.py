"""Mixtures of sources with target shares of all tokens.

Documents are counted into cells of source, language and topic. Iterative proportional fitting rakes
the cells' token weights to the sources' target amounts and to the corpus's language and topic
marginals, no weight above the source's cap; documents are then drawn by their calibrated weights.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.tokenize import count_tokens
from lodestone.session import cut_lineage

#: Languages and topics with a smaller share of the tokens are one cell, so the cells are bounded by sources / SMALL ** 2.
SMALL = 0.005
#: Bins of the draw's threshold, a source.
BINS = 8192


def attainable(available: np.ndarray, shares: np.ndarray, caps: np.ndarray, total: float) -> np.ndarray:
    """The tokens of each source in a mixture of ``total``: its share of it, or all its capped tokens if that is less."""
    return np.minimum(shares * total, available * caps)


def attainable_total(available: np.ndarray, shares: np.ndarray, caps: np.ndarray) -> float:
    """The largest mixture in which every source that has any tokens has its share."""
    wanted = (shares > 0) & (available > 0)
    return float(np.min(available[wanted] * caps[wanted] / shares[wanted])) if wanted.any() else 0.0


def rake(tokens: np.ndarray, source: np.ndarray, language: np.ndarray, topic: np.ndarray, goals: np.ndarray, caps: np.ndarray, rounds: int = 200) -> np.ndarray:
    """The weight of each cell: sources meet ``goals``, languages and topics keep their shares as far as the caps allow.

    ``tokens`` of the cells; ``source``, ``language`` and ``topic`` are codes; the last step is always
    the sources', so their goals are met exactly (where their cells can hold them).
    """
    weights = np.ones(len(tokens))
    limit = caps[source]
    wanted = goals.sum()
    per_source = np.bincount(source, tokens, len(goals))
    marginals = [(codes, np.bincount(codes, tokens * (per_source[source] > 0)) / max(tokens.sum(), 1) * wanted) for codes in (language, topic)]
    for _ in range(rounds):
        before = weights.copy()
        for codes, target in marginals:
            have = np.bincount(codes, tokens * weights, len(target))
            weights = np.minimum(weights * np.where(have > 0, target / np.maximum(have, 1e-12), 1.0)[codes], limit)
        weights = _fill(tokens, weights, source, goals, limit)
        if np.abs(weights - before).max() < 1e-9:
            break
    return weights


def _fill(tokens: np.ndarray, weights: np.ndarray, source: np.ndarray, goals: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """``weights`` scaled source by source to ``goals``; what a capped cell cannot hold goes to the source's others."""
    weights = np.maximum(weights, 1e-9)
    for _ in range(60):
        have = np.bincount(source, tokens * weights, len(goals))
        free = weights < limit * (1 - 1e-12)
        loose = np.bincount(source, tokens * weights * free, len(goals))
        gap = goals - have
        if (np.abs(gap) <= 1e-9 * np.maximum(goals, 1)).all():
            break
        up = 1 + np.where(loose > 0, gap / np.maximum(loose, 1e-12), 0.0)
        down = goals / np.maximum(have, 1e-12)
        weights = np.where(gap[source] < 0, weights * down[source], np.where(free, np.minimum(weights * up[source], limit), weights))
    return weights


def mix(df: DataFrame, targets: DataFrame, key: str, text: str, source: str, language: str, topic: str, total: int | str | None = None, vocabulary: str | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares). mixture: ``key``, source, language, topic, n_tokens, weight, uses (1 or more); shares: source, target_share,
    actual_share, available_tokens, mixed_tokens, n_documents, capped.

    ``targets``: source, target_share, max_repeats, a row a source; documents of other or null sources
    and of no tokens are not used. ``total`` is the mixture's size in tokens, by default that of all
    used documents: a source gets its share of it, or max_repeats times its tokens if that is less, and
    ``capped`` tells so. ``total="attainable"`` is the largest size at which no source is capped. Null languages and topics are a value of their own. A document's uses are the
    whole part of its weight and one more by the fraction, by a hash of ``key``, under one factor a
    source that brings the drawn tokens to the goal; never more than max_repeats. Repeated keys are
    drawn alike. An empty table gives an empty mixture and shares of 0 (null actual_share).
    """
    spark = df.sparkSession
    wanted = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.collect()}
    names = sorted(wanted)
    own = df.select(F.col(key).alias("k"), F.col(source).alias("s"), F.coalesce(F.col(language), F.lit("")).alias("l"), F.coalesce(F.col(topic), F.lit("")).alias("t"), F.col(text).alias("x")).where(F.col("s").isin(names))
    packed = own.select(F.struct("k", "s", "l", "t").alias("row"), "x")
    counted = count_tokens(packed, "row", "x", vocabulary).select("row.*", "n_tokens").where("n_tokens > 0")
    counted = cut_lineage(counted.withColumn("u", (F.pmod(F.xxhash64(F.col("k"), F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)))
    everything = counted.agg(F.sum("n_tokens")).collect()[0][0] or 0
    named = {c: [r[0] for r in counted.groupBy(c).agg(F.sum("n_tokens").alias("n")).where(F.col("n") >= SMALL * everything).collect()] for c in ("l", "t")}
    for column, kept in named.items():
        counted = counted.withColumn(column, F.when(F.col(column).isin(kept), F.col(column)).otherwise("\0"))
    cells = counted.groupBy("s", "l", "t").agg(F.sum("n_tokens").alias("n")).collect()
    shares, caps = np.array([wanted[n][0] for n in names]), np.array([float(wanted[n][1]) for n in names])
    at = np.array([names.index(c["s"]) for c in cells], int)
    tokens = np.array([float(c["n"]) for c in cells])
    available = np.bincount(at, tokens, len(names))
    size = attainable_total(available, shares, caps) if total == "attainable" else float(total if total is not None else everything)
    goals = attainable(available, shares, caps, size)
    codes = [np.unique([c[x] for c in cells], return_inverse=True)[1] if cells else np.zeros(0, int) for x in ("l", "t")]
    weights = rake(tokens, at, *codes, goals, caps) if cells else np.zeros(0)
    schema = T.StructType([T.StructField("s", T.StringType()), T.StructField("l", T.StringType()), T.StructField("t", T.StringType()), T.StructField("weight", T.DoubleType())])
    fitted = spark.createDataFrame([(c["s"], c["l"], c["t"], float(w)) for c, w in zip(cells, weights)], schema)
    repeats = F.element_at(F.create_map(*[F.lit(x) for n in names for x in (n, wanted[n][1])]), F.col("s"))
    weighted = counted.join(F.broadcast(fitted), ["s", "l", "t"]).withColumn("cap", repeats)
    # A document's j-th use takes place if the source's factor reaches (u + j) / weight; the factors lie near 1.
    steps = weighted.select("s", "n_tokens", F.explode(F.sequence(F.lit(0), F.col("cap") - 1)).alias("j"), "u", "weight")
    place = F.least(F.greatest(F.floor(F.coalesce(F.try_divide(F.col("u") + F.col("j"), F.col("weight")), F.lit(2.0)) * (BINS / 2)), F.lit(0)), F.lit(BINS))
    histogram = steps.select("s", place.cast("int").alias("bin"), "n_tokens").groupBy("s", "bin").agg(F.sum("n_tokens").alias("n")).collect()
    factor = {}
    for i, name in enumerate(names):
        mass = np.zeros(BINS + 1)
        for r in histogram:
            if r["s"] == name:
                mass[r["bin"]] += r["n"]
        reached = np.concatenate([[0.0], np.cumsum(mass[:BINS])])
        factor[name] = float(np.argmin(np.abs(reached - goals[i])) / (BINS / 2)) if goals[i] < available[i] * caps[i] * (1 - 1e-9) else float("inf")
    by_source = F.element_at(F.create_map(*[F.lit(x) for n in names for x in (n, factor[n])]), F.col("s"))
    drawn = weighted.withColumn("uses", F.least(F.greatest(F.ceil(F.when(by_source == float("inf"), F.col("cap").cast("double")).otherwise(by_source * F.col("weight") - F.col("u"))), F.lit(0)), F.col("cap")).cast("int"))
    mixture = drawn.where("uses > 0").select(F.col("k").alias(key), F.col("s").alias("source"), F.col("l").alias("language"), F.col("t").alias("topic"), "n_tokens", "weight", "uses")
    goal_rows = spark.createDataFrame([(n, wanted[n][0], int(available[i]), bool(shares[i] * size > available[i] * caps[i] * (1 + 1e-9))) for i, n in enumerate(names)], "source string, target_share double, available_tokens bigint, capped boolean")
    reached = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("m"), F.count("*").alias("n"))
    whole = mixture.agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("whole"))
    report = goal_rows.join(reached, "source", "left").join(F.broadcast(whole.withColumn("one", F.lit(1))), F.lit(1) == F.col("one"))
    return mixture, report.select("source", "target_share", (F.coalesce("m", F.lit(0)) / F.col("whole")).alias("actual_share"), "available_tokens", F.coalesce("m", F.lit(0)).alias("mixed_tokens"), F.coalesce("n", F.lit(0)).alias("n_documents"), "capped")


def marginals(mixture: DataFrame, everything: DataFrame) -> DataFrame:
    """(marginal, value, corpus_share, mixed_share): how the languages and topics of a ``mixture`` of :func:`mix` keep their shares of the tokens.

    ``everything``: the same with no source capped or repeated, that is every used document once. Small
    languages and topics are one value (null); values that are missing on a side have a share of 0 there.
    """
    def shares(df: DataFrame, out: str) -> DataFrame:
        cells = df.groupBy("language", "topic").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("n"))
        each = cells.select(F.explode(F.array(F.struct(F.lit("language").alias("marginal"), F.col("language").alias("value")), F.struct(F.lit("topic").alias("marginal"), F.col("topic").alias("value")))).alias("m"), "n").select("m.*", "n")
        sums = each.groupBy("marginal", "value").agg(F.sum("n").alias("n"))
        return sums.withColumn(out, F.col("n") / F.sum("n").over(Window.partitionBy("marginal"))).drop("n")  # a row a cell, bounded by SMALL

    both = shares(everything, "corpus_share").join(shares(mixture, "mixed_share"), ["marginal", "value"], "full")
    return both.select("marginal", F.nullif("value", F.lit("\0")).alias("value"), F.coalesce("corpus_share", F.lit(0.0)).alias("corpus_share"), F.coalesce("mixed_share", F.lit(0.0)).alias("mixed_share"))

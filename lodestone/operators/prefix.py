"""Running values over ordered groups of any size.

A window over a whole group puts a hot group into one task. Here each group is cut into buckets of
its order; the buckets are summed up first, the sums are carried forward, and the rows of a bucket
continue from what comes in. All values wanted are carried in one pass, which reads its input twice
(once for the sums, once for the rows), however many they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 4096


def bucket_of(order: str, bucket: int = BUCKET) -> Column:
    return F.floor(F.col(order) / bucket).alias("_bucket")


def with_carried(rows: DataFrame, carried: DataFrame, group: list[str]) -> DataFrame:
    """``rows`` beside the columns of ``carried`` (a row a group and ``_bucket``); null groups are groups."""
    names = [c for c in carried.columns if c not in (*group, "_bucket")]
    other = carried.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_bucket").alias("_gb"), *names)
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    return rows.join(other, [*same, F.col("_bucket") == F.col("_gb")], "left").drop(*[f"_g{i}" for i in range(len(group))], "_gb")


def running(df: DataFrame, group: list[str], order: str, values: dict[str, tuple[str, Column]], bucket: int = BUCKET) -> DataFrame:
    """``df`` with the running ``values``: name -> (kind, column); ``order`` is an integer, unique in the group.

    Kinds: ``last``, the last non-null value up to and with the row; ``sum``, the sum up to and with
    the row; ``previous``, the value of the row before as a struct with the one field ``v`` (null for
    the first row).
    """
    rows = df.select("*", bucket_of(order, bucket), *[(F.struct(v.alias("v")) if kind == "previous" else v).alias(f"_v{i}") for i, (kind, v) in enumerate(values.values())])
    own = Window.partitionBy(*group, "_bucket").orderBy(order)
    upto, earlier = own.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums, carried, results = [], [], {}
    for i, (name, (kind, _)) in enumerate(values.items()):
        value, came = F.col(f"_v{i}"), F.col(f"_in{i}")
        if kind == "sum":
            sums.append(F.sum(value).alias(f"_w{i}"))
            carried.append(F.sum(f"_w{i}").over(earlier).alias(f"_in{i}"))
            results[name] = F.coalesce(F.sum(value).over(upto), F.lit(0)) + F.coalesce(came, F.lit(0))
        else:
            sums.append(F.max_by(value, F.when(value.isNotNull(), F.col(order))).alias(f"_w{i}"))
            carried.append(F.last(f"_w{i}", True).over(earlier).alias(f"_in{i}"))
            results[name] = F.coalesce(F.last(value, True).over(upto) if kind == "last" else F.lag(value).over(own), came)
    whole = rows.groupBy(*group, "_bucket").agg(*sums).select(*group, "_bucket", *carried)
    made = with_carried(rows, whole, group).withColumns(results)
    return made.drop("_bucket", *[f"_{x}{i}" for i in range(len(values)) for x in ("v", "in")])


def carry_last(df: DataFrame, group: list[str], order: str, value: Column, out: str, bucket: int = BUCKET) -> DataFrame:
    """``df`` with ``out``: the last non-null ``value`` of the group up to and with the row."""
    return running(df, group, order, {out: ("last", value)}, bucket)

"""Places and medians of values inside groups of any size.

Everything works on one row per value of a group, with its count, so that any
number of ties is one row. A group's values are dealt to ranges between quantiles
of a sketch, and a range's start, plus the running count inside it, is the number
of smaller values: a window holds a range, never a group. A bad quantile makes
ranges uneven and changes no place. NaN is above all numbers and null below."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGES, ACCURACY = 64, 1000


def placed(values: DataFrame, by: list[str], ranges: int = RANGES) -> DataFrame:
    """values: `by`, value, n, and others; one row per value. Adds less, the number
    of rows of smaller value in the group, and total, that of all its rows."""
    names = [f"_k{i}" for i in range(len(by))]
    keys = [F.col(c).alias(k) for c, k in zip(by, names, strict=True)]
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, names, strict=True)]
    cuts = F.percentile_approx("value", F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), ACCURACY)
    groups = values.groupBy(*keys).agg(cuts.alias("_cuts"), F.sum("n").alias("total"))
    above = F.coalesce(F.size(F.filter("_cuts", lambda c: F.col("value") > c)), F.lit(0))
    dealt = values.join(groups, same).withColumn("_range", F.greatest(above, F.lit(0))).drop("_cuts", *names)
    # as many rows as there are ranges
    ahead = Window.partitionBy(*names).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*keys, F.col("_range").alias("_at")).agg(F.sum("n").alias("_n"))
    starts = starts.select(*names, "_at", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*by, "_range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    counted = dealt.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    counted = counted.join(starts, [*same, F.col("_range") == F.col("_at")])
    return counted.withColumn("less", F.col("_start") + F.col("_inside")).drop("_range", "_at", "_start", "_inside", *names)


def values_of(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows: `by`, value. One row per value, and n."""
    return rows.groupBy(*by, "value").agg(F.count("*").alias("n"))


def medians(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows: `by`, value (null and NaN are left out). `by`, median: the exact one,
    the mean of the middle two if they are two; no row for a group without values."""
    at = placed(values_of(rows.where(F.col("value").isNotNull() & ~F.isnan("value")), by), by)
    holds = lambda place: F.max(F.when((F.col("less") <= place) & (place < F.col("less") + F.col("n")), F.col("value")))
    middle = at.groupBy(*by).agg(holds(F.floor((F.col("total") - 1) / 2)).alias("_lo"), holds(F.floor(F.col("total") / 2)).alias("_hi"))
    return middle.select(*by, F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(0.5 * F.col("_lo") + 0.5 * F.col("_hi")).alias("median"))


def ranks(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows: `by`, value, and others. Adds r: the rank of value in its group from 1,
    averaged over ties. Rows meet the ranks of values in a join, so that ties of
    a third of all rows can be split."""
    at = placed(values_of(rows, by), by).select(*[F.col(c).alias(f"_j{i}") for i, c in enumerate(by)], F.col("value").alias("_v"), (F.col("less") + (F.col("n") + 1) / 2.0).alias("r"))
    same = [F.col(c).eqNullSafe(F.col(f"_j{i}")) for i, c in enumerate(by)]
    return rows.join(at, [*same, F.col("value").eqNullSafe(F.col("_v"))]).drop("_v", *[f"_j{i}" for i in range(len(by))])

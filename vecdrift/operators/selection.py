"""Which rows to work on: samples, shards and pending work. All draws are
orders by md5 of (seed, id), the same on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import keyed_order


def numeric_suffix(sample_id: Column) -> Column:
    return F.regexp_extract(sample_id, r"_([0-9]+)$", 1).try_cast("long")


def subsample(samples: DataFrame, n: int | None, seed: int = 42) -> DataFrame:
    """n samples, in the order of their numeric suffix; all if n is null or not
    below their number."""
    if n is None:
        return samples
    return samples.orderBy(keyed_order(seed, "sample_id"), "sample_id").limit(n).orderBy(numeric_suffix(F.col("sample_id")), "sample_id")


def calibration_ids(ids: DataFrame, n: int | None, seed: int = 42) -> DataFrame:
    """min(n, all) ids, sorted."""
    rows = ids.select("sample_id")
    return (rows if n is None else rows.orderBy(keyed_order(seed, "sample_id"), "sample_id").limit(n)).orderBy("sample_id")


def stride_shard(rows: DataFrame, k: int, n: int, by: str = "idx") -> DataFrame:
    """Rows k, k+n, k+2n, ... in the order of `by`. Positions come from per-bucket
    counts and a window inside each bucket, not from one global window."""
    if not 0 <= k < n:
        raise ValueError(f"shard {k} of {n}")
    return with_position(rows, by).where(F.col("_pos") % n == k).drop("_pos")


def with_position(rows: DataFrame, by: str, buckets: int = 64, within: tuple[str, ...] = ()) -> DataFrame:
    """Adds _pos, from 0 in the order of `by` (nulls first, then NaN last; equal
    ones in the order of a digest of the row), within each group of `within`.
    Range buckets, their running totals (one row per group and bucket), and a
    window inside each, so that no group meets in one task."""
    edges = sorted({e for e in rows.approxQuantile(by, [i / buckets for i in range(1, buckets)], 0.001)})
    bucket = F.when(F.col(by).isNull(), -1)
    for i, e in enumerate(edges):
        bucket = bucket.when(F.col(by) <= e, i)
    rows = rows.withColumn("_b", bucket.otherwise(len(edges)))
    before = Window.partitionBy(*within).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*within, "_b").count().select(*[F.col(w).alias(f"_w_{w}") for w in within], F.col("_b").alias("_w_b"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*within, "_b").orderBy(F.col(by).asc_nulls_first(), F.xxhash64(*rows.columns))) - 1
    same = F.col("_b") == F.col("_w_b")
    for w in within:
        same = same & F.col(w).eqNullSafe(F.col(f"_w_{w}"))
    return rows.withColumn("_in", inside).join(F.broadcast(starts), same).withColumn("_pos", F.col("_start") + F.col("_in")).drop("_b", "_in", "_start", "_w_b", *[f"_w_{w}" for w in within])


def pending(work: DataFrame, complete: DataFrame) -> DataFrame:
    """Work without what is complete, in the order of idx."""
    return work.join(complete.select("sample_id").distinct(), "sample_id", "left_anti").orderBy("idx")


def work_list(work: DataFrame, complete: DataFrame, k: int = 0, n: int = 1, limit: int | None = None, most: int | None = None) -> DataFrame:
    """A resumable list: the shard, the first `limit` of it, less what is
    complete, at most `most` of the rest."""
    rows = stride_shard(work, k, n)
    if limit is not None:
        rows = rows.orderBy("idx").limit(limit)
    rows = pending(rows, complete)
    return rows if most is None else rows.limit(most)


def labelled(rows: DataFrame, label: str = "is_hallucination") -> DataFrame:
    return rows.where(F.col(label).isNotNull())


def gradable(rows: DataFrame) -> DataFrame:
    """Not failed, and with generated text."""
    return rows.where(~F.coalesce("failed", F.lit(False)) & (F.coalesce("generated_text", F.lit("")) != ""))


def having_scores(rows: DataFrame, cache: DataFrame) -> tuple[DataFrame, int]:
    """(rows with cached scores, number of samples skipped)."""
    ids = cache.select("sample_id").distinct()
    return rows.join(ids, "sample_id", "left_semi"), rows.join(ids, "sample_id", "left_anti").count()


def realign(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows in the order of a list of ids; ids without a row give nulls."""
    return ids.join(rows, "sample_id", "left").orderBy("idx")

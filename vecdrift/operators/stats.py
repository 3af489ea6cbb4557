"""AUROC, resampling and scans, as relational operations.

Scores are first grouped, so that running counts are over distinct scores, and
counted in two levels (ranges of values, then inside a range; see ranking.py);
the resampled forms are in resample.py."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import folded, keyed_number
from .ranking import medians, placed, ranks
from .resample import MOST_REDRAWS, permuted_rank_sums, replicates

N_BOOTSTRAP, N_PERMUTATION, ALPHAS, PERCENTILE = 10_000, 1_000, (0.05, 0.025), 95.0


def _auroc_of_groups(groups: DataFrame, by: list[str]) -> DataFrame:
    """groups: by, value, pos, neg, n. One row per `by`; null with one class, NaN
    with a NaN score."""
    rank = F.col("less") + (F.col("n") + 1) / 2.0
    sums = placed(groups, by).groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("pos") * rank).alias("rank_sum"), F.max(F.isnan("value")).alias("_nan"))
    a = _ranked_auroc(F.col("rank_sum"), F.col("n_pos"), F.col("n_neg"))
    return sums.withColumn("auroc", F.when(F.col("_nan") & a.isNotNull(), F.lit(float("nan"))).otherwise(a)).drop("rank_sum", "_nan")


def _ranked_auroc(rank_sum: Column, n_pos: Column, n_neg: Column) -> Column:
    return F.try_divide(rank_sum - n_pos * (n_pos + 1) / 2.0, (n_pos * n_neg).cast("double"))


def _score_groups(rows: DataFrame, by: list[str], y: str, score: str) -> DataFrame:
    labelled = rows.where(F.col(y).isNotNull() & F.col(score).isNotNull())
    pos, neg = F.sum((F.col(y) == 1).cast("long")), F.sum((F.col(y) == 0).cast("long"))
    return labelled.groupBy(*by, F.col(score).cast("double").alias("value")).agg(pos.alias("pos"), neg.alias("neg"), (pos + neg).alias("n"))


def auroc_by(rows: DataFrame, by: list[str], y: str = "y", score: str = "score") -> DataFrame:
    return _auroc_of_groups(_score_groups(rows, by, y, score), by)


def auroc(rows: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """One row: n_pos, n_neg, auroc (average ranks on ties; null with one class,
    NaN with a NaN score)."""
    one = auroc_by(rows.select(y, score, F.lit(0).alias("_all")), ["_all"], y, score)
    return one.agg(F.coalesce(F.max("n_pos"), F.lit(0)).alias("n_pos"), F.coalesce(F.max("n_neg"), F.lit(0)).alias("n_neg"), F.max("auroc").alias("auroc"))


def draws(rows: DataFrame, n_bootstrap: int, seed: int = 42) -> DataFrame:
    """rows: y and whatever else, with idx from 0. b, and the drawn rows: n with
    replacement per replicate, for statistics that resample.replicates() has not. A
    draw with one class only is replaced by the next attempt, of MOST_REDRAWS, and
    it is an error if all have one; attempts are made for the replicates that need
    them. Raises if rows don't hold both classes. Rows go to every task up to
    100,000 of them; beyond, the cells of all replicates are shuffled on idx."""
    n, classes = rows.agg(F.count("*"), F.count_distinct("y")).first()
    if classes < 2:
        raise ValueError("a bootstrap needs rows of both classes")
    spark = rows.sparkSession
    few = F.broadcast(rows) if n <= 100_000 else rows

    def tried(replicates: DataFrame, first: int, last: int) -> DataFrame:
        cells = replicates.withColumn("a", F.explode(F.sequence(F.lit(first), F.lit(last))))
        # two levels: no array is longer than the root of n
        side = math.isqrt(n - 1) + 1
        cells = cells.withColumn("_u", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // side)))).withColumn("_v", F.explode(F.sequence(F.lit(0), F.lit(side - 1))))
        cells = cells.withColumn("j", F.col("_u").cast("long") * side + F.col("_v")).where(F.col("j") < n).drop("_u", "_v")
        cells = cells.withColumn("idx", keyed_number(seed, "b", "a", "j") % n)
        return cells.join(few, "idx").drop("j")

    def mixed(drawn: DataFrame) -> DataFrame:
        return drawn.groupBy("b", "a").agg(F.min("y").alias("lo"), F.max("y").alias("hi")).where("lo < hi").groupBy("b").agg(F.min("a").alias("a"))

    replicates = spark.range(n_bootstrap).withColumnRenamed("id", "b").repartition(spark.sparkContext.defaultParallelism)
    first = tried(replicates, 0, 0)
    good = mixed(first).select("b")
    left = replicates.join(good, "b", "left_anti")
    again = tried(left, 1, MOST_REDRAWS)
    chosen = left.join(mixed(again), "b", "left").withColumn("a", F.when(F.col("a").isNull(), F.raise_error(F.lit(f"no draw of both classes in {MOST_REDRAWS} attempts"))).otherwise(F.col("a")))
    return first.join(good, "b", "left_semi").unionByName(again.join(chosen, ["b", "a"])).drop("a")


def _interval(values: DataFrame, value: str, point: DataFrame, alphas: tuple[float, ...], above: float) -> DataFrame:
    """alpha, estimate, lower, upper, and whether the lower end is above."""
    cuts = [values.agg(F.expr(f"percentile({value}, {a / 2})").alias("lower"), F.expr(f"percentile({value}, {1 - a / 2})").alias("upper"), F.count("*").alias("n_draws")).withColumn("alpha", F.lit(a)) for a in alphas]
    rows = cuts[0]
    for c in cuts[1:]:
        rows = rows.unionByName(c)
    return rows.crossJoin(F.broadcast(point)).withColumn("above", F.col("lower") > above)


def bootstrap_auroc_ci(rows: DataFrame, n_bootstrap: int = N_BOOTSTRAP, seed: int = 42, alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """rows: idx, y, score. One row per alpha: estimate, lower, upper, n_draws,
    above (the lower end is above one half)."""
    each = replicates(rows, ("score",), n_bootstrap, seed)
    return _interval(each, "score", auroc_by(rows.withColumn("one", F.lit(1)), ["one"]).select(F.col("auroc").alias("estimate")), alphas, 0.5)


def paired_draws(rows: DataFrame, n_bootstrap: int, seed: int = 42) -> DataFrame:
    """rows: idx, y, full, base. b, delta: both AUROCs on the same draws."""
    return replicates(rows, ("full", "base"), n_bootstrap, seed).select("b", (F.col("full") - F.col("base")).alias("delta"))


def paired_bootstrap_delta(rows: DataFrame, n_bootstrap: int = N_BOOTSTRAP, seed: int = 42, alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """One row per alpha: estimate, lower, upper, n_draws, above (zero)."""
    long = rows.select("y", F.explode(F.create_map(F.lit("full"), F.col("full").cast("double"), F.lit("base"), F.col("base").cast("double"))).alias("which", "score"))
    point = auroc_by(long, ["which"]).agg((F.max(F.when(F.col("which") == "full", F.col("auroc"))) - F.max(F.when(F.col("which") == "base", F.col("auroc")))).alias("estimate"))
    return _interval(paired_draws(rows, n_bootstrap, seed), "delta", point, alphas, 0.0)


def bonferroni(intervals: DataFrame, n_tests: int = 2, family: float = 0.05) -> DataFrame:
    """The decision at family / n_tests."""
    return intervals.where(F.abs(F.col("alpha") - family / n_tests) < 1e-12).select("estimate", "lower", F.col("above").alias("significant"))


def histogram(values: DataFrame, value: str, low: float, high: float, bins: int = 40) -> DataFrame:
    """bin (from 1), n."""
    return values.groupBy(F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def median_imputed(rows: DataFrame) -> DataFrame:
    """rows: sample_id, feature, value. NaN and null become the feature's exact
    median, and 0 where a feature has no value at all. The medians are found at
    once, one row per feature, which is a column of a table."""
    clean = F.when(~F.isnan("value"), F.col("value"))
    found = medians(rows, ["feature"])
    found = rows.sparkSession.createDataFrame(found.collect(), found.schema)
    return rows.join(found, "feature", "left").withColumn("value", F.coalesce(clean, "median", F.lit(0.0))).drop("median")


def average_ranks(rows: DataFrame) -> DataFrame:
    """Adds r: the rank of value within its feature, averaged over ties."""
    return ranks(rows, ["feature"])


def per_feature_folded_auroc(rows: DataFrame) -> DataFrame:
    """rows: sample_id, feature, value, y. feature, auroc, folded_auroc."""
    rows = rows.persist()
    try:
        filled = auroc_by(median_imputed(rows), ["feature"], score="value")
        found = filled.select("feature", "auroc", folded("auroc").alias("folded_auroc"))
        return rows.sparkSession.createDataFrame(found.collect(), found.schema)  # one row per feature
    finally:
        rows.unpersist()


def permutation_null(rows: DataFrame, n_permutation: int, seed: int = 42) -> DataFrame:
    """b, null_max: labels are dealt anew (the n_pos ids of least md5 are
    positive), and the largest folded AUROC over all features is kept. Ranks are
    made once and multiplied with the labels in blocks."""
    return _null_of(average_ranks(median_imputed(rows)), n_permutation, seed)


def _null_of(ranked: DataFrame, n_permutation: int, seed: int) -> DataFrame:
    ids = ranked.select("sample_id", "y").distinct()
    n, n_pos = ids.agg(F.count("*"), F.coalesce(F.sum(F.col("y").cast("long")), F.lit(0))).first()
    sums = permuted_rank_sums(ranked.select("sample_id", "feature", "r"), ids, n_pos, n_permutation, seed)
    a = _ranked_auroc(F.col("rank_sum"), F.lit(n_pos), F.lit(n - n_pos))
    return sums.select("b", folded(a).alias("f")).groupBy("b").agg(F.max("f").alias("null_max"))


def permutation_scan(rows: DataFrame, n_permutation: int = N_PERMUTATION, seed: int = 42, percentile: float = PERCENTILE) -> DataFrame:
    """One row per feature: auroc, folded_auroc, threshold, significant (strictly
    above), and n_significant over all. Rows without a label are left out. Ranks are
    made once, for the scan and its null."""
    rows = rows.where(F.col("y").isNotNull()).persist()
    ranked = average_ranks(median_imputed(rows)).persist()
    try:
        threshold = _null_of(ranked, n_permutation, seed).agg(F.expr(f"percentile(null_max, {percentile / 100})")).first()[0]
        n_pos = F.sum((F.col("y") == 1).cast("long"))
        sums = ranked.groupBy("feature").agg(F.sum(F.when(F.col("y") == 1, F.col("r")).otherwise(0.0)).alias("rank_sum"), n_pos.alias("n_pos"), (F.count("*") - n_pos).alias("n_neg"))
        scan = sums.select("feature", _ranked_auroc(F.col("rank_sum"), F.col("n_pos"), F.col("n_neg")).alias("auroc"))
        scan = rows.sparkSession.createDataFrame(scan.collect(), scan.schema)  # one row per feature
    finally:
        ranked.unpersist(), rows.unpersist()
    found = scan.withColumn("folded_auroc", folded("auroc")).withColumn("threshold", F.lit(threshold).cast("double")).withColumn("significant", F.col("folded_auroc") > F.col("threshold"))
    return found.withColumn("n_significant", F.sum(F.col("significant").cast("long")).over(Window.partitionBy()))


def best_layer_per_group(profile: DataFrame, threshold: float | None = None) -> DataFrame:
    """profile: group, layer, auroc. The best layer of each group, the first on
    ties, and whether it is above the threshold."""
    order = Window.partitionBy("group").orderBy(F.col("auroc").desc(), "layer")
    best = profile.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return best if threshold is None else best.withColumn("above", F.col("auroc") > threshold)


def group_profile(per_feature: DataFrame) -> DataFrame:
    """{group}_l{layer} names to group, layer, auroc."""
    return per_feature.select(F.regexp_extract("feature", r"^(.*)_l([0-9]+)$", 1).alias("group"), F.regexp_extract("feature", r"_l([0-9]+)$", 1).cast("int").alias("layer"), F.col("folded_auroc").alias("auroc"))


def per_category_auroc(rows: DataFrame, min_n: int = 10) -> DataFrame:
    """rows: category, y, score. Categories (null is "(none)") with at least
    min_n rows and both classes: n, rate, auroc; largest first, then by name."""
    named = rows.withColumn("category", F.coalesce("category", F.lit("(none)")))
    found = auroc_by(named, ["category"]).withColumn("n", F.col("n_pos") + F.col("n_neg")).where((F.col("n") >= min_n) & (F.col("n_pos") > 0) & (F.col("n_neg") > 0))
    return found.select("category", "n", (F.col("n_pos") / F.col("n")).alias("rate"), "auroc").orderBy(F.col("n").desc(), "category")

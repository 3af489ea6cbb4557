"""How results change with the inverse temperature. Rows are scanned once for
all of them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calibration import BETA_GRID
from .features import BASELINES, GROUPS, feature_columns, feature_long, pivot_features
from .kernel import metric_rows, norm_entropies
from .probe import in_samples, run_protocols
from .selection import having_scores
from .tiled import metrics_by_beta, scalars_by_beta
from .trajectory import metrics_of_scores

FEW_LABELLED = 20


def cached_scores(cache: DataFrame) -> DataFrame:
    """The score cache with double scores; raises if it is empty."""
    if cache.isEmpty():
        raise ValueError("no cached scores: run the trajectories with a score cache first")
    return cache.withColumn("scores", F.col("scores").cast("array<double>"))


def features_at_beta(cache: DataFrame, beta: float) -> DataFrame:
    """Long features of every cached sample at beta; the quadratic term is
    passed through."""
    return feature_long(metrics_of_scores(cached_scores(cache), beta))


def feature_table_at_beta(cache: DataFrame, meta: DataFrame, beta: float, n_layers: int, labels: DataFrame | None = None, baselines: DataFrame | None = None) -> tuple[DataFrame, int]:
    """(wide table, samples skipped for want of a cache)."""
    have, skipped = having_scores(meta, cache)
    wide = have.join(pivot_features(features_at_beta(cache, beta), n_layers), "sample_id")
    for more in (baselines, labels):
        if more is not None:
            wide = wide.join(more, "sample_id", "left")
    return wide, skipped


def full_sweep(cache: DataFrame, grid: tuple[float, ...] = BETA_GRID) -> DataFrame:
    """Long features for every beta, from one pass: (beta, sample_id, layer)."""
    return feature_long(metric_rows(cached_scores(cache), grid), by=("beta",))


def entropy_sweep(cache: DataFrame, grid: tuple[float, ...] = BETA_GRID) -> DataFrame:
    """Only delta_norm_entropy for every beta: (beta, sample_id, layer). Scores
    stay in their task; one number per row and beta leaves it."""
    return _entropy_deltas(norm_entropies(cached_scores(cache), grid, ("sample_id", "layer", "position")))


def entropy_sweep_of_points(points: DataFrame, bank: DataFrame, grid: tuple[float, ...] = BETA_GRID, way: str = "auto") -> DataFrame:
    """entropy_sweep() without a cache: points meet the bank tile by tile, once for
    all betas, and no row of scores is held."""
    return _entropy_deltas(scalars_by_beta(points, bank, grid, way).withColumnRenamed("norm_entropy", "h"))


def full_sweep_of_points(points: DataFrame, bank: DataFrame, grid: tuple[float, ...] = BETA_GRID, way: str = "auto") -> DataFrame:
    """full_sweep() without a cache, likewise."""
    return feature_long(metrics_by_beta(points, bank, grid, way), by=("beta",))


def _entropy_deltas(h: DataFrame) -> DataFrame:
    mean = F.avg(F.when(F.col("position") > 0, F.col("h"))) - F.max(F.when(F.col("position") == 0, F.col("h")))
    return h.groupBy("beta", "sample_id", "layer").agg(mean.alias("delta_norm_entropy"))


def mean_over_layers(sweep: DataFrame) -> DataFrame:
    """beta, sample_id, mean_delta_hbar."""
    return sweep.groupBy("beta", "sample_id").agg(F.avg("delta_norm_entropy").alias("mean_delta_hbar"))


def replace_band(wide: DataFrame, group: str, long: DataFrame, n_layers: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The wide table with one group's columns taken from long rows (once for each
    value of `by`)."""
    names = [f"{group}_l{i}" for i in range(n_layers)]
    return wide.drop(*names).join(pivot_features(long, n_layers, (group,), by), "sample_id")


def _probe_aurocs(rows: DataFrame, columns: list[str], grid: tuple[float, ...], **how) -> DataFrame:
    """rows: beta and what run_protocol() needs. beta, probe_auroc: the protocol's
    test AUROC on the labelled rows of each beta. Without a split or with few rows,
    in sample with C = 1; without both classes NaN. All betas are fitted together."""
    rows = rows.where(F.col("y").isNotNull()).persist()
    seen = {r["beta"]: r for r in rows.groupBy("beta").agg(F.count("*").alias("n"), F.count_distinct("y").alias("classes")).collect()}  # one row per beta
    both = [b for b in grid if b in seen and seen[b]["classes"] > 1]
    few = [b for b in both if seen[b]["n"] < FEW_LABELLED or "split" not in rows.columns]
    many = [b for b in both if b not in few]
    got = {b: r["test_auroc"] for b, r in run_protocols(rows, columns, "beta", many, **how).items()} if many else {}
    if few:
        got |= in_samples(rows, columns, "beta", few)
    rows.unpersist()
    out = [(float(b), math.nan if got.get(b) is None else float(got[b])) for b in grid]
    return rows.sparkSession.createDataFrame(out, "beta double, probe_auroc double")


def beta_probe_sweep(wide: DataFrame, sweep: DataFrame, n_layers: int, grid: tuple[float, ...] = BETA_GRID, **how) -> DataFrame:
    """wide: features, y and perhaps split; sweep: entropy_sweep(). beta,
    probe_auroc: the full probe with only the delta_norm_entropy band taken at
    beta (see _probe_aurocs)."""
    columns = [*[b for b in BASELINES if b in wide.columns], *feature_columns(n_layers, GROUPS)]
    return _probe_aurocs(replace_band(wide, "delta_norm_entropy", sweep, n_layers, ("beta",)), columns, grid, **how)


def full_probe_sweep(sweep: DataFrame, samples: DataFrame, n_layers: int, grid: tuple[float, ...] = BETA_GRID, **how) -> DataFrame:
    """sweep: full_sweep(); samples: sample_id, y, perhaps split and baselines,
    the same for every beta. beta, probe_auroc: the full probe on the table that
    is recomputed as a whole at beta (see _probe_aurocs)."""
    columns = [*[b for b in BASELINES if b in samples.columns], *feature_columns(n_layers, GROUPS)]
    return _probe_aurocs(samples.join(pivot_features(sweep, n_layers, GROUPS, ("beta",)), "sample_id"), columns, grid, **how)


def sensitivity_table(sweep: DataFrame, labels: DataFrame, probes: DataFrame | None = None) -> DataFrame:
    """beta, sample_id, mean_delta_hbar, is_hallucination, probe_auroc."""
    rows = mean_over_layers(sweep).join(labels.select("sample_id", "is_hallucination"), "sample_id", "left")
    return rows.join(F.broadcast(probes), "beta", "left") if probes is not None else rows.withColumn("probe_auroc", F.lit(None).cast("double"))


def beta_class_means(table: DataFrame) -> DataFrame:
    """beta, is_hallucination, mean_delta_hbar; unlabelled samples are left out."""
    return table.dropna(subset=["is_hallucination"]).groupBy("beta", "is_hallucination").agg(F.avg("mean_delta_hbar").alias("mean_delta_hbar"))


def auroc_curve(table: DataFrame) -> DataFrame:
    """beta, probe_auroc, one row per beta."""
    return table.groupBy("beta").agg(F.first("probe_auroc").alias("probe_auroc")).orderBy("beta")

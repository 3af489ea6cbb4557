"""Choosing the inverse temperature."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernel import norm_entropies
from .selection import calibration_ids
from .tiled import scalars_by_beta

BETA_GRID = (1.0, 2.0, 5.0, 10.0, 15.0, 20.0, 30.0, 50.0, 100.0)
TARGET = 0.55
N_CALIBRATION = 30


def norm_entropy_curve(scored: DataFrame, grid: tuple[float, ...] = BETA_GRID) -> DataFrame:
    """scored: sample_id, layer, scores (reference positions). beta,
    mean_norm_entropy: the mean over samples of the mean over layers."""
    return _curve(norm_entropies(scored, grid, ("sample_id",)))


def reference_curve(points: DataFrame, bank: DataFrame, grid: tuple[float, ...] = BETA_GRID, way: str = "auto") -> DataFrame:
    """The same from points and a bank: no row of scores is held."""
    return _curve(scalars_by_beta(points.where("position = 0"), bank, grid, way).select("sample_id", "beta", F.col("norm_entropy").alias("h")))


def _curve(h: DataFrame) -> DataFrame:
    per = h.groupBy("beta", "sample_id").agg(F.avg("h").alias("h"))
    return per.groupBy("beta").agg(F.avg("h").alias("mean_norm_entropy"))


def interpolate_beta(curve: DataFrame, target: float = TARGET) -> DataFrame:
    """One row: beta_star, clamped. The first pair of neighbouring grid points
    that brackets the target, log-linear between them; without one, the
    nearest grid point. The curve has one row per beta: a single task."""
    w = Window.orderBy("beta")
    c = curve.select("beta", F.col("mean_norm_entropy").alias("h")).withColumn("h2", F.lead("h").over(w)).withColumn("b2", F.lead("beta").over(w))
    part = F.when(F.col("h") == F.col("h2"), 0.0).otherwise((F.col("h") - target) / (F.col("h") - F.col("h2")))
    star = F.exp(F.log("beta") + part * (F.log("b2") - F.log("beta")))
    found = c.where((F.col("h") >= target) & (F.lit(target) >= F.col("h2"))).orderBy("beta").limit(1).select(star.alias("beta_star"), F.lit(False).alias("clamped"))
    near = c.orderBy(F.abs(F.col("h") - target), "beta").limit(1).select(F.col("beta").alias("beta_star"), F.lit(True).alias("clamped"))
    return found.unionByName(near).orderBy("clamped").limit(1)


def calibrate(points: DataFrame, bank: DataFrame, n: int | None = N_CALIBRATION, grid: tuple[float, ...] = BETA_GRID, target: float = TARGET, seed: int = 42) -> DataFrame:
    """One record: beta_star, clamped, target, grid, curve, ids, n."""
    ids = calibration_ids(points.select("sample_id").distinct(), n, seed)
    own = points.join(F.broadcast(ids), "sample_id", "left_semi") if n is not None else points
    curve = reference_curve(own, bank, grid).cache()
    packed = curve.agg(F.sort_array(F.collect_list(F.struct("beta", "mean_norm_entropy"))).alias("curve"))
    named = ids.agg(F.sort_array(F.collect_list("sample_id")).alias("ids"), F.count("*").alias("n"))
    return interpolate_beta(curve, target).crossJoin(packed).crossJoin(named).withColumn("target", F.lit(target))


def require_beta(beta_star: float | None) -> float:
    if beta_star is None:
        raise ValueError("beta_star is not set: calibrate first")
    return float(beta_star)

"""Sample features pooled from trajectories, long and wide."""

from __future__ import annotations

import re

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUPS = ("delta_energy", "delta_norm_entropy", "mean_js", "mean_hellinger_sq")
DIAGNOSTICS = ("delta_entropy", "gen_energy_mean", "gen_norm_entropy_mean")
BASELINES = ("seq_logprob", "token_entropy_mean")


def feature_long(traj: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(sample_id, layer, *by): GROUPS and DIAGNOSTICS, in one aggregation:
    means over the generated positions minus the reference. NaN stays NaN."""
    gen, ref = F.col("position") > 0, F.col("position") == 0
    mean = lambda x: F.avg(F.when(gen, x))
    at_ref = lambda x: F.max(F.when(ref, x))
    e = F.col("lse_term") + F.col("quadratic_term")
    return traj.groupBy("sample_id", "layer", *by).agg(
        (mean(e) - at_ref(e)).alias("delta_energy"),
        (mean(F.col("norm_entropy")) - at_ref(F.col("norm_entropy"))).alias("delta_norm_entropy"),
        mean(F.col("js")).alias("mean_js"),
        mean(F.col("hellinger_sq")).alias("mean_hellinger_sq"),
        (mean(F.col("entropy")) - at_ref(F.col("entropy"))).alias("delta_entropy"),
        mean(e).alias("gen_energy_mean"),
        mean(F.col("norm_entropy")).alias("gen_norm_entropy_mean"),
    )


def token_baselines(token_rows: DataFrame) -> DataFrame:
    """sample_id, seq_logprob, token_entropy_mean."""
    return token_rows.groupBy("sample_id").agg(F.avg("logprob").alias("seq_logprob"), F.avg("predictive_entropy").alias("token_entropy_mean"))


def feature_columns(n_layers: int, groups: tuple[str, ...] = GROUPS) -> list[str]:
    """Group-major, layer-minor."""
    return [f"{g}_l{i}" for g in groups for i in range(n_layers)]


def infer_n_layers(df: DataFrame) -> int:
    found = [int(m[1]) for c in df.columns if (m := re.fullmatch(r"delta_energy_l(\d+)", c))]
    if not found:
        raise ValueError("no delta_energy_l* column")
    return max(found) + 1


def pivot_features(long: DataFrame, n_layers: int, groups: tuple[str, ...] = GROUPS + DIAGNOSTICS, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per sample (and value of `by`) with {group}_l{layer} columns. The layers are given,
    so that no job runs to find them and the order is fixed."""
    wide = long.groupBy("sample_id", *by).pivot("layer", list(range(n_layers))).agg(*[F.first(g).alias(g) for g in groups])
    if len(groups) == 1:  # a single aggregate does not name its columns
        wide = wide.withColumnsRenamed({str(i): f"{i}_{groups[0]}" for i in range(n_layers)})
    return wide.select("sample_id", *by, *[F.col(f"{i}_{g}").alias(f"{g}_l{i}") for g in groups for i in range(n_layers)])


def check_layer_counts(long: DataFrame) -> int:
    """The number of layers; raises if samples differ in it."""
    r = long.groupBy("sample_id").agg(F.count_distinct("layer").alias("n")).agg(F.min("n"), F.max("n")).first()
    if r[0] != r[1]:
        raise ValueError(f"samples have between {r[0]} and {r[1]} layers")
    return r[1]


def feature_table(traj: DataFrame, meta: DataFrame | None = None, baselines: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """Wide features, joined with metadata (inner), baselines (left) and labels
    (left: unlabelled samples have null is_hallucination)."""
    long = feature_long(traj)
    wide = pivot_features(long, check_layer_counts(long))
    if meta is not None:
        wide = meta.join(wide, "sample_id")
    if baselines is not None:
        wide = wide.join(baselines, "sample_id", "left")
    if labels is not None:
        wide = wide.join(labels.select("sample_id", "is_hallucination"), "sample_id", "left")
    return wide


def phi_vector(wide: DataFrame, n_layers: int | None = None) -> DataFrame:
    """sample_id, phi: the 4L features as one vector; NaN is kept."""
    columns = feature_columns(n_layers or infer_n_layers(wide))
    return VectorAssembler(inputCols=columns, outputCol="phi", handleInvalid="keep").transform(wide).select("sample_id", "phi")


def baseline_matrix(wide: DataFrame) -> DataFrame:
    return wide.select("sample_id", *BASELINES)

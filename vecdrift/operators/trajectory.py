"""Metrics per (sample, layer, position); position 0 is the reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from .bank import check_layers
from .kernel import metric_rows
from .scoring import score
from .tiled import point_metrics

SCALARS = ("lse_term", "quadratic_term", "entropy", "norm_entropy")
METRICS = (*SCALARS, "js", "hellinger_sq")
KEYS = ("sample_id", "layer", "position")


def tag_positions(points: DataFrame, n_prompt: str = "n_prompt") -> DataFrame:
    """Absolute positions to relative ones: the last prompt position is 0, the
    generated ones follow from 1; earlier ones go."""
    return points.withColumn("position", (F.col("position") - (F.col(n_prompt) - 1)).cast("int")).where("position >= 0").withColumn("is_ref", F.col("position") == 0)


def split_failures(points: DataFrame, dim: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(good points, failures). A sample fails as a whole if one of its vectors
    is null, of the wrong length or not finite, if it has no reference, or if
    it has no position after it. failures: sample_id, error."""
    finite = F.forall("r", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    length = F.size("r") == dim if dim is not None else F.size("r") > 0
    problem = F.when(F.col("r").isNull(), "missing vector").when(~length, "wrong length").when(~finite, "not finite")
    per = points.groupBy("sample_id").agg(F.min(problem).alias("bad"), F.max((F.col("position") == 0).cast("int")).alias("ref"), F.max((F.col("position") > 0).cast("int")).alias("gen"))
    per = per.withColumn("error", F.coalesce("bad", F.when(F.col("ref") == 0, "no reference position"), F.when(F.col("gen") == 0, "zero generated tokens")))
    failures = per.where(F.col("error").isNotNull()).select("sample_id", "error")
    return points.join(failures, "sample_id", "left_anti"), failures


def metrics_of_scores(scored: DataFrame, beta: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """scored: keys, scores, and r or quadratic_term. The six metrics; js and
    hellinger_sq are null at the reference (see metric_rows)."""
    return metric_rows(scored, (float(beta),), keep).drop("beta")


def trajectories(points: DataFrame, bank: DataFrame, beta: float, way: str = "auto") -> DataFrame:
    """The metrics of points. Vectors are shuffled to their references; scores are
    never held (see point_metrics)."""
    check_layers(points, bank)
    return point_metrics(points, bank, float(beta), way)


def reference_scores(points: DataFrame, bank: DataFrame, way: str = "auto") -> DataFrame:
    """Scores of the reference positions only; the filter comes before the join."""
    return score(points.where("position = 0"), bank, way)


def score_cache(points: DataFrame, bank: DataFrame, way: str = "auto") -> DataFrame:
    """What a later run at another temperature needs: keys, scores (float) and
    quadratic_term. Raises if layers have different numbers of patterns."""
    scored = score(points, bank, way)
    widths = bank.groupBy("layer").count().select("count").distinct().count()
    if widths > 1:
        raise ValueError("the bank's layers have different numbers of patterns")
    return scored.select(*KEYS, F.col("scores").cast("array<float>").alias("scores"), M.quadratic_term("r").alias("quadratic_term"))


def nan_placeholders(failures: DataFrame, n_layers: int) -> DataFrame:
    """Rows of NaN for failed samples: every layer, the reference and position 1."""
    grid = F.explode(F.sequence(F.lit(0), F.lit(n_layers - 1)))
    rows = failures.select("sample_id", grid.alias("layer")).withColumn("position", F.explode(F.array(F.lit(0), F.lit(1))))
    nan, gen = F.lit(float("nan")), F.col("position") > 0
    return rows.select(*KEYS, *[nan.alias(m) for m in SCALARS], *[F.when(gen, nan).alias(m) for m in ("js", "hellinger_sq")])


def run_trajectories(points: DataFrame, bank: DataFrame, beta: float, dim: int | None = None, done: DataFrame | None = None, way: str = "auto") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(metrics with NaN rows for the failed samples, failures, report). Samples
    in `done` are skipped. report: n_done, n_failed, n_skipped."""
    todo = points if done is None else points.join(done.select("sample_id").distinct(), "sample_id", "left_anti")
    good, failures = split_failures(todo, dim)
    layers = bank.agg(F.max("layer")).first()[0] + 1
    rows = point_metrics(good, bank, float(beta), way).unionByName(nan_placeholders(failures, layers))
    report = (
        good.agg(F.count_distinct("sample_id").alias("n_done"))
        .crossJoin(failures.agg(F.count("*").alias("n_failed")))
        .crossJoin(points.agg(F.count_distinct("sample_id").alias("_all")))
        .select("n_done", "n_failed", (F.col("_all") - F.col("n_done") - F.col("n_failed")).alias("n_skipped"))
    )
    return rows, failures, report


def token_metrics(tokens: DataFrame) -> DataFrame:
    """tokens: sample_id, position, logits, chosen. logprob, predictive_entropy."""
    return tokens.select("sample_id", "position", M.token_logprob("logits", "chosen").alias("logprob"), M.predictive_entropy("logits").alias("predictive_entropy"))

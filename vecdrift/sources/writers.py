"""Writers. Spark's commit protocol marks a result complete (_SUCCESS)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.labels import human_subset


def write_trajectories(rows: DataFrame, path: str, scores: DataFrame | None = None, meta: DataFrame | None = None, mode: str = "append") -> None:
    """Arrays first, then scores, then the metadata that marks samples complete."""
    rows.write.mode(mode).partitionBy("layer").parquet(f"{path}/trajectories")
    if scores is not None:
        scores.write.mode(mode).option("compression", "zstd").partitionBy("layer").parquet(f"{path}/scores")
    if meta is not None:
        meta.write.mode(mode).json(f"{path}/meta")


def append_failures(failures: DataFrame, path: str) -> None:
    failures.withColumn("time", F.unix_timestamp()).write.mode("append").json(path)


def write_table(rows: DataFrame, path: str) -> None:
    """CSV with a header if the path says so, else parquet."""
    if path.rstrip("/").endswith(".csv"):
        rows.write.mode("overwrite").option("header", True).csv(path)
    else:
        rows.write.mode("overwrite").parquet(path)


def write_results(row: DataFrame, path: str) -> None:
    """A one-row summary as JSON."""
    row.coalesce(1).write.mode("overwrite").json(path)


def write_human_template(labels: DataFrame, path: str, n: int = 60, seed: int = 42) -> None:
    human_subset(labels, n, seed).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_calibration(record: DataFrame, scores: DataFrame, path: str) -> None:
    scores.write.mode("overwrite").parquet(f"{path}/scores")
    write_results(record, f"{path}/record")

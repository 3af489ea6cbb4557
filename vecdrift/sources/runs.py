"""Results of several tables that appear together.

A batch of a run writes each of its tables under batch=<key>/attempt=<id>, and
then one line of the manifest. Readers take what the manifest lists, for each
batch its last line; so a crash between any two writes leaves the batch unlisted,
and a rerun under the same key adds it once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST = "batch string, attempt string, tables array<string>, committed_at double"


def commit_batch(spark: SparkSession, path: str, batch: str, tables: dict[str, DataFrame], replace: bool = False) -> bool:
    """Writes tables as one batch. A batch that is listed already stays as it is
    (False), unless replace is set: then its new rows take the place of all of
    its old ones at once."""
    batch = str(batch)
    if not replace and not manifest(spark, path).where(F.col("batch") == batch).isEmpty():
        return False
    attempt = uuid.uuid4().hex
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}/attempt={attempt}")
    line = spark.range(1).select(F.lit(batch).alias("batch"), F.lit(attempt).alias("attempt"), F.array(*[F.lit(t) for t in sorted(tables)]).cast("array<string>").alias("tables"), F.unix_micros(F.current_timestamp()).cast("double").alias("committed_at"))
    line.coalesce(1).write.mode("append").json(f"{path}/manifest")
    return True


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's readers find the folder; other errors are not hidden."""
    try:
        return bool(spark.read.format("binaryFile").load(path).schema)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """batch, attempt, tables, committed_at: the line of each batch that holds."""
    if not _exists(spark, f"{path}/manifest"):
        return spark.createDataFrame([], MANIFEST)
    lines = spark.read.schema(MANIFEST).json(f"{path}/manifest")
    last = Window.partitionBy("batch").orderBy(F.col("committed_at").desc(), "attempt")
    return lines.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def read_batches(spark: SparkSession, path: str, table: str) -> DataFrame | None:
    """The rows of a table in all batches that the manifest lists, with `batch`;
    None if there are none. Folders of other attempts are not read."""
    have = [(r.batch, r.attempt) for r in manifest(spark, path).where(F.array_contains("tables", table)).collect()]  # one row per batch
    if not have:
        return None
    folders = [f"{path}/{table}/batch={b}/attempt={a}" for b, a in have]
    return spark.read.option("basePath", f"{path}/{table}").parquet(*folders).withColumn("batch", F.col("batch").cast("string")).drop("attempt")

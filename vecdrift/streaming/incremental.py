"""Resumable runs over arriving points, as a stream that ends when it has caught up.

assembled() gathers a sample's points from any number of files and runs: a
stateful operator keeps them, keyed by sample, until all its positions are there,
and lets the sample go on once. run_incremental() computes the metrics of whole
samples and commits each batch with its failures as one (sources/runs.py). The
checkpoint remembers which files are done and the state, so a rerun without new
files adds nothing, and a batch that is run again after a failure is listed once."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.scoring import score
from ..operators.tiled import point_metrics
from ..operators.trajectory import split_failures
from ..sources.runs import commit_batch, read_batches

DAY_MS = 24 * 3600 * 1000
#: The only state store that transformWithState takes; and no batches without
#: data, as a stream with timers would never have caught up.
STREAM = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Assembly(StatefulProcessor):
    """Points of one sample until they are complete: n_layers times (the
    reference and n_tokens_generated positions). A point that comes twice counts
    once, by its first vector. Emits the points together, or one row with an
    error: a point outside the grid, or not complete at `timeout_ms` after the first
    one (seen in the next batch). What comes for a sample that is done is left
    out, for `remember_ms`."""

    def __init__(self, n_layers: int, timeout_ms: int, remember_ms: int):
        self.n_layers, self.timeout_ms, self.remember_ms = n_layers, timeout_ms, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.points = handle.getListState("points", "layer int, position int, r array<double>")
        self.progress = handle.getValueState("progress", "positions int, seen binary")
        self.done = handle.getValueState("done", "ok boolean", self.remember_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        if self.done.exists():
            for _ in rows:
                pass
            return
        positions, seen = None, set()
        if self.progress.exists():
            positions, packed = self.progress.get()
            seen = set(np.frombuffer(packed, np.int64).tolist())
        else:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
        for part in rows:
            have = part["n_tokens_generated"].dropna()
            if positions is None and len(have):
                positions = int(have.iloc[0]) + 1
            fresh = []
            for layer, position, r in zip(part["layer"], part["position"], part["r"], strict=True):
                if pd.isna(layer) or pd.isna(position) or not 0 <= layer < self.n_layers or position < 0:
                    yield from self._end(key, "a point outside the layers and positions")
                    for _ in rows:
                        pass
                    return
                at = int(position) * self.n_layers + int(layer)
                if at not in seen:
                    seen.add(at)
                    fresh.append((int(layer), int(position), None if r is None else [float(x) for x in r]))
            if fresh:
                self.points.appendList(fresh)
        if positions is not None and seen and max(seen) >= positions * self.n_layers:
            yield from self._end(key, "more positions than n_tokens_generated")
        elif positions is not None and len(seen) == positions * self.n_layers:
            yield from self._end(key, None)
        else:
            self.progress.update((positions, np.array(sorted(seen), np.int64).tobytes()))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.progress.exists() and not self.done.exists():
            positions, packed = self.progress.get()
            want = "unknown" if positions is None else str(positions * self.n_layers)
            yield from self._end(key, f"incomplete: {len(packed) // 8} of {want} points")

    def _end(self, key: Any, error: str | None) -> Iterator[pd.DataFrame]:
        names = ["sample_id", "layer", "position", "r", "error"]
        if error is None:
            held = []
            for layer, position, r in self.points.get():
                held.append((key[0], layer, position, r, None))
                if len(held) >= 1000:
                    yield pd.DataFrame(held, columns=names)
                    held = []
            if held:
                yield pd.DataFrame(held, columns=names)
        else:
            yield pd.DataFrame([(key[0], None, None, None, error)], columns=names)
        self.points.clear()
        self.progress.clear()
        self.done.update((error is None,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def close(self) -> None:
        pass


def assembled(points: DataFrame, n_layers: int, timeout_ms: int = DAY_MS, remember_ms: int = 30 * DAY_MS) -> DataFrame:
    """A stream of points (sample_id, layer, position, r, n_tokens_generated; the
    last one on at least one point of a sample) to one of whole samples: sample_id,
    layer, position, r, error. Points without a sample_id are one sample, which
    cannot be told apart: it fails like any other."""
    id_type = points.schema["sample_id"].dataType.simpleString()
    rows = points.select("sample_id", F.col("layer").cast("int").alias("layer"), F.col("position").cast("int").alias("position"), F.col("r").cast("array<double>").alias("r"), F.col("n_tokens_generated").cast("int").alias("n_tokens_generated"))
    return rows.groupBy("sample_id").transformWithStateInPandas(Assembly(n_layers, timeout_ms, remember_ms), f"sample_id {id_type}, layer int, position int, r array<double>, error string", "append", "ProcessingTime")


def run_incremental(spark: SparkSession, points_path: str, points_schema: str, bank: DataFrame, beta: float, out: str, checkpoint: str, timeout_ms: int = DAY_MS) -> None:
    """New points files to metrics and failures under `out` (read_incremental,
    read_failures). With a column n_tokens_generated a sample may lie in several
    files; without, a file holds whole samples."""
    stream = spark.readStream.schema(points_schema).parquet(points_path)
    parts = "n_tokens_generated" in stream.columns
    if parts:
        stream = assembled(stream, bank.agg(F.max("layer")).first()[0] + 1, timeout_ms)

    def one(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # read for both tables
        whole = batch.where("error is null").drop("error") if parts else batch
        good, failures = split_failures(whole)
        if parts:
            failures = failures.unionByName(batch.where("error is not null").select("sample_id", "error"))
        commit_batch(spark, out, str(number), {"trajectories": point_metrics(good, bank, beta), "failures": failures})
        batch.unpersist()

    # a stream takes the settings that hold when it starts
    with _settings(spark, STREAM if parts else {}):
        query = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def read_incremental(spark: SparkSession, out: str) -> DataFrame:
    return read_batches(spark, out, "trajectories").drop("batch")


def read_failures(spark: SparkSession, out: str) -> DataFrame:
    """sample_id, error."""
    return read_batches(spark, out, "failures").drop("batch")

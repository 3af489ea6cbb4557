"""Scoring vectors against the bank of their layer.

Two ways with the same result: a bank whose packed size is within a limit is
broadcast; a larger one meets the points in a cogroup on (layer, part), where a
layer's samples are dealt into parts and each part does one matrix product. A
product, a part's scores and an Arrow batch are of some CELLS or PART_CELLS numbers,
however wide the bank is. This is for callers who want whole rows of scores; metrics
of points and long rows of scores do without (tiled.py)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bank import pack
from .kernel import CELLS

BROADCAST_NUMBERS = 1_000_000
PART_POINTS, PART_CELLS = 4096, 1 << 22


def bank_numbers(bank: DataFrame) -> int:
    return bank.agg(F.sum(F.size("m_hat"))).first()[0] or 0


def score(points: DataFrame, bank: DataFrame, way: str = "auto") -> DataFrame:
    """points: sample_id, layer, position, r. Adds scores (in the order of
    pattern_id)."""
    if way == "auto":
        way = "array" if bank_numbers(bank) <= BROADCAST_NUMBERS else "matrix"
    return _score_broadcast(points, bank) if way == "array" else _score_matrix(points, bank)


def _with_scores(schema) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", scores array<double>"


def _score_broadcast(points: DataFrame, bank: DataFrame) -> DataFrame:
    layers = {r["layer"]: np.array(r["m_hat"], float) for r in pack(bank).select("layer", "m_hat").toLocalIterator()}  # of a checked size
    known = points.sparkSession.sparkContext.broadcast(layers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column("layer").to_pylist()
            for layer, m in known.value.items():
                rows = np.array([i for i, x in enumerate(of) if x == layer], np.int64)
                some = max(1, CELLS // len(m))
                for i in range(0, len(rows), some):
                    own = batch.take(pa.array(rows[i : i + some]))
                    has = np.flatnonzero(own.column("r").is_valid().to_numpy(zero_copy_only=False))
                    r = np.array(own.column("r").take(pa.array(has)).to_pylist(), float).reshape(len(has), -1)
                    s = r @ m.T if len(has) else np.zeros((0, len(m)))
                    at = np.zeros(len(own) + 1, np.int32)
                    at[1 + has] = len(m)
                    scores = pa.ListArray.from_arrays(pa.array(np.cumsum(at), pa.int32()), pa.array(s.ravel()), mask=own.column("r").is_null())
                    yield pa.record_batch([*own.columns, scores], [*own.schema.names, "scores"])

    return points.mapInArrow(run, _with_scores(points.schema))


def _score_matrix(points: DataFrame, bank: DataFrame) -> DataFrame:
    widths = bank.groupBy("layer").agg(F.count("*").alias("_k"))
    most = F.greatest(F.lit(1), F.least(F.lit(PART_POINTS), F.floor(PART_CELLS / F.col("_k"))))
    sizes = points.groupBy("layer").count().join(widths, "layer").select("layer", F.ceil(F.col("count") / most).cast("int").alias("_parts"))
    keyed = points.join(F.broadcast(sizes), "layer")  # one row per layer
    place = F.xxhash64("sample_id", "position") if "position" in points.columns else F.xxhash64("sample_id")
    keyed = keyed.withColumn("_part", F.pmod(place, F.col("_parts"))).drop("_parts")
    spread = bank.join(F.broadcast(sizes), "layer").select("layer", "pattern_id", "m_hat", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_part"))

    def product(p: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        p = p.drop(columns="_part").sort_values(["sample_id", "position"])
        if not len(p) or not len(b):
            return p.iloc[:0].assign(scores=pd.Series([], dtype=object))
        m = np.stack(b.sort_values("pattern_id")["m_hat"].to_numpy())
        return p.assign(scores=list(np.stack(p["r"].to_numpy()) @ m.T))

    return keyed.select(*points.columns, "_part").groupBy("layer", "_part").cogroup(spread.groupBy("layer", "_part")).applyInPandas(product, _with_scores(points.schema))


def long_scores(scored: DataFrame, bank: DataFrame) -> DataFrame:
    """sample_id, layer, position, pattern_id, s: one row per score (for banks
    that are narrow enough to list)."""
    ids = pack(bank).select("layer", "pattern_ids")
    cells = scored.join(ids, "layer").select("sample_id", "layer", "position", F.explode(F.arrays_zip("pattern_ids", "scores")).alias("c"))
    return cells.select("sample_id", "layer", "position", F.col("c.pattern_ids").alias("pattern_id"), F.col("c.scores").alias("s"))

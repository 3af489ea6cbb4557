"""Banks of unit-norm patterns: one row per (layer, pattern)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as M

PROJECTIONS = {"gate": "gate", "value": "value", "w2": "w2"}
REJECTED = ("down", "down_proj")
#: Columns of a tile when a matrix is transposed.
TILE = 64


def resolve_projection(bank_id: str) -> str:
    if bank_id in REJECTED:
        raise ValueError(f"{bank_id!r} maps to the output space and cannot serve as a bank")
    if bank_id not in PROJECTIONS:
        raise ValueError(f"unknown bank {bank_id!r}; known: {', '.join(sorted(PROJECTIONS))}")
    return PROJECTIONS[bank_id]


def tiles(weights: DataFrame) -> DataFrame:
    """layer, pattern_id, weights in tiles of an Arrow batch's rows by TILE columns,
    transposed: layer, block (of columns), width (of the rows), ids of the rows, cells
    (a column's numbers after another's). A row without weights is left out."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.filter(pc.is_valid(batch.column("weights")))
            width = pc.list_value_length(own.column("weights")).to_numpy(zero_copy_only=False)
            flat = own.column("weights").flatten().to_numpy(zero_copy_only=False)
            starts, ids = np.cumsum(np.r_[0, width]), own.column("pattern_id").to_numpy(zero_copy_only=False)
            layers = own.column("layer").dictionary_encode()
            code = layers.indices.to_numpy(zero_copy_only=False)
            for layer in range(len(layers.dictionary)):
                for w in np.unique(width[code == layer]):
                    rows = np.flatnonzero((code == layer) & (width == w))
                    for block in range(max(1, -(-int(w) // TILE))):  # an empty row is a tile, too
                        columns = np.arange(block * TILE, min(w, (block + 1) * TILE))
                        cells = flat[starts[rows] + columns[:, None]].ravel()
                        tile = [layers.dictionary.take(pa.array([layer])), pa.array([block], pa.int32()), pa.array([w], pa.int32()), pa.array([ids[rows]], pa.list_(pa.int64())), pa.array([cells], pa.list_(pa.float64()))]
                        yield pa.record_batch(tile, ["layer", "block", "width", "ids", "cells"])

    kind = weights.schema["layer"].dataType.simpleString()
    numbers = weights.select("layer", F.col("pattern_id").cast("long").alias("pattern_id"), F.col("weights").cast("array<double>").alias("weights"))
    return numbers.mapInArrow(cut, f"layer {kind}, block int, width int, ids array<bigint>, cells array<double>")


def transpose(weights: DataFrame) -> DataFrame:
    """layer, pattern_id, weights: rows become columns, per layer. The new rows
    are numbered from 0 by the old position and hold the old rows in the order of
    pattern_id. Tiles are shuffled, and TILE new rows are joined in a task. Null
    numbers become NaN; rows of a layer that are not all of one length raise."""

    def join(group: pa.Table) -> pa.Table:
        width = group.column("width").to_numpy()
        if (width != width[0]).any():
            raise ValueError(f"layer {group.column('layer')[0]} has rows of other lengths: {sorted(set(width.tolist()))}")
        block = group.column("block")[0].as_py()
        n = min(TILE, int(width[0]) - block * TILE)
        ids = np.concatenate([t.values.to_numpy(zero_copy_only=False) for t in group.column("ids")])
        order = np.argsort(ids, kind="stable")
        parts = zip(group.column("ids"), group.column("cells"), strict=True)
        cells = np.concatenate([t.values.to_numpy(zero_copy_only=False).reshape(n, len(i)) for i, t in parts], 1)[:, order]
        offsets = pa.array(np.arange(n + 1) * len(ids), pa.int32())
        return pa.table([group.column("layer").slice(0, 1).combine_chunks().take(pa.array(np.zeros(n, np.int64))), pa.array(block * TILE + np.arange(n), pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(cells.ravel()))], ["layer", "pattern_id", "weights"])

    kind = weights.schema["layer"].dataType.simpleString()
    return tiles(weights).groupBy("layer", "block").applyInArrow(join, f"layer {kind}, pattern_id int, weights array<double>")


def build_bank(weights: DataFrame, bank_id: str = "gate", model_id: str | None = None) -> DataFrame:
    """weights: layer, pattern_id, weights and, if several matrices are in it,
    projection. Returns bank_id, model_id, layer, pattern_id, m_hat, row_norm;
    the norm is stored as it is, the division uses at least EPS."""
    projection = resolve_projection(bank_id)
    if "projection" in weights.columns:
        weights = weights.where(F.col("projection") == projection)
    if bank_id == "w2":
        weights = transpose(weights)
    return weights.select(F.lit(bank_id).alias("bank_id"), F.lit(model_id).cast("string").alias("model_id"), "layer", "pattern_id", M.l2_normalised("weights").alias("m_hat"), M.l2_norm("weights").alias("row_norm"))


def bank_dims(bank: DataFrame) -> DataFrame:
    """layer, n_patterns, dim."""
    return bank.groupBy("layer").agg(F.count("*").alias("n_patterns"), F.max(F.size("m_hat")).alias("dim"))


def pack(bank: DataFrame) -> DataFrame:
    """One row per layer: ids and rows, in the order of pattern_id."""
    one = bank.groupBy("layer").agg(F.sort_array(F.collect_list(F.struct("pattern_id", "m_hat"))).alias("p"))
    return one.select("layer", F.transform("p", lambda x: x["pattern_id"]).alias("pattern_ids"), F.transform("p", lambda x: x["m_hat"]).alias("m_hat"))


def raw_preactivation(scores: DataFrame, bank: DataFrame) -> DataFrame:
    """scores: layer, pattern_id, s and, if they have it already, row_norm. Adds
    g = s * row_norm."""
    if "row_norm" in scores.columns:
        return scores.withColumn("g", F.col("s") * F.col("row_norm"))
    return scores.join(bank.select("layer", "pattern_id", "row_norm"), ["layer", "pattern_id"]).withColumn("g", F.col("s") * F.col("row_norm"))


def check_layers(points: DataFrame, bank: DataFrame) -> None:
    """Raises if data and bank have different layers."""
    have = {r[0] for r in points.select("layer").distinct().collect()}
    banked = {r[0] for r in bank.select("layer").distinct().collect()}
    if have != banked:
        raise ValueError(f"layers differ: data has {sorted(have)}, bank has {sorted(banked)}")


def last_pattern(bank: DataFrame) -> DataFrame:
    """The pattern with the greatest norm per layer, first id on ties."""
    order = Window.partitionBy("layer").orderBy(F.col("row_norm").desc(), "pattern_id")
    return bank.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")

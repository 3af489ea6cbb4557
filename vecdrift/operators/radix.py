"""Exact medians of many columns over many sets of rows, by their bits.

A double's bits, made to ascend with its value, are settled eight at a time, for all
columns and sets at once: a task counts the next eight bits of the values that begin
like the median, and the counts tell how it goes on. As soon as few values are left,
they are fetched; else all 64 bits are settled, so that ties may be of any number.
Nothing of the length of a column is held in a task or exchanged."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

DIGIT, FETCHED = 8, 1 << 20
BINS = 1 << DIGIT
#: A batch's numbers (rows, columns), and the places of each set's rows.
Unpack = Callable[[pa.RecordBatch], tuple[np.ndarray, dict[int, np.ndarray]]]


def ascending(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of x; both zeros are one."""
    bits = (x + 0.0).view(np.int64)
    return (bits ^ ((bits >> 63) | np.int64(-(1 << 63)))).view(np.uint64)


def values(bits: np.ndarray) -> np.ndarray:
    """The numbers of ascending()."""
    own = bits.view(np.int64)
    return np.where(own < 0, own ^ np.int64(-(1 << 63)), ~own).view(np.float64)


def packed_sums(partial: DataFrame, few: bool) -> dict[int, np.ndarray]:
    """partial: fit, v, one row per fit and task; the sums by fit. few: the driver
    adds them, else Spark."""
    if not few:
        partial = partial.groupBy("fit").applyInArrow(lambda t: packed([t.column("fit")[0].as_py()], [np.sum(np.stack(t.column("v").to_numpy()), 0)]), partial.schema)
    total: dict[int, np.ndarray] = {}
    for batch in partial.toArrow().to_batches():
        for fit, v in zip(batch.column("fit").to_pylist(), batch.column("v"), strict=True):
            total[fit] = total.get(fit, 0.0) + v.values.to_numpy()
    return total


def packed(fits: list[int], sums: list[np.ndarray]) -> pa.Table:
    return pa.table({"fit": pa.array(fits, pa.int64()), "v": pa.array(sums, pa.list_(pa.float64()))})


def medians(data: DataFrame, unpack: Unpack, have: dict[int, np.ndarray], few: bool, fetched: int = FETCHED) -> dict[int, np.ndarray]:
    """have: for each set the number of values (not NaN) in each column. The medians
    of each set's columns, the mean of the middle two if they are two, and 0 without
    values."""
    sets = sorted(have)
    count = np.array([have[s] for s in sets], np.int64).reshape(len(sets), -1)
    rank = np.maximum(np.stack([(count - 1) // 2, count // 2]), 0)  # (2, sets, columns)
    prefix, left, depth = np.zeros(rank.shape, np.uint64), np.stack([count, count]), 0

    def alike(x: np.ndarray, i: int, prefix: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For both middles: the bits, and which ones begin like the middle."""
        bits, ok = ascending(x), ~np.isnan(x)
        for t in range(2):
            yield bits, ok & (bits >> np.uint64(64 - depth) == prefix[t, i]) if depth else ok

    while depth < 64 and left.sum() > fetched:

        def count_digits(batches, prefix=prefix, depth=depth):
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                x, rows = unpack(batch)
                for i, s in enumerate(sets):
                    if s in rows:
                        own = total.setdefault(s, np.zeros((2, x.shape[1] * BINS)))
                        for t, (bits, like) in enumerate(alike(x[rows[s]], i, prefix, depth)):
                            digit = (bits >> np.uint64(64 - DIGIT - depth)).astype(np.int64) % BINS + np.arange(x.shape[1]) * BINS
                            own[t] += np.bincount(digit[like], minlength=own.shape[1])
            yield from packed(list(total), [v.ravel() for v in total.values()]).to_batches()

        sums = packed_sums(data.mapInArrow(count_digits, "fit long, v array<double>"), few)
        for i, s in enumerate(sets):
            if s not in sums:
                continue
            upto = np.cumsum(sums[s].reshape(2, -1, BINS), 2).astype(np.int64)
            digit = np.minimum((upto <= rank[:, i, :, None]).sum(2), BINS - 1)
            at = np.take_along_axis(upto, digit[:, :, None], 2)[:, :, 0]
            before = np.where(digit > 0, np.take_along_axis(upto, np.maximum(digit - 1, 0)[:, :, None], 2)[:, :, 0], 0)
            prefix[:, i] = (prefix[:, i] << np.uint64(DIGIT)) | digit.astype(np.uint64)
            rank[:, i], left[:, i] = rank[:, i] - before, at - before
        depth += DIGIT
    if depth == 64:
        middle = values(prefix)
    else:

        def fetch(batches):
            for batch in batches:
                x, rows = unpack(batch)
                for i, s in enumerate(sets):
                    if s in rows:
                        for t, (bits, like) in enumerate(alike(x[rows[s]], i, prefix, depth)):
                            row, column = np.nonzero(like)
                            if len(row):
                                cell = (t * len(sets) + i) * x.shape[1] + column
                                yield pa.record_batch([pa.array(cell), pa.array(bits[row, column].view(np.int64))], ["cell", "bits"])

        table = data.mapInArrow(fetch, "cell long, bits long").toArrow()  # at most `fetched` rows
        cell, bits = table.column("cell").to_numpy(), table.column("bits").to_numpy().view(np.uint64)
        order = np.lexsort((bits, cell))
        starts = np.searchsorted(cell[order], np.arange(rank.size))
        place = starts + rank.ravel()
        found = np.zeros(rank.size, np.uint64)
        some = (left > 0).ravel()
        found[some] = bits[order][place[some]]
        middle = values(found).reshape(rank.shape)
    middle = np.where(count > 0, np.where(middle[0] == middle[1], middle[0], 0.5 * middle[0] + 0.5 * middle[1]), 0.0)
    return {s: middle[i] for i, s in enumerate(sets)}

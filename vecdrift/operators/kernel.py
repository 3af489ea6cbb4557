"""The metrics of score rows at one or more temperatures, with numpy inside tasks.

A task works on blocks of some rows that fit a core's cache; scores come in once
and six numbers go out for each row and beta, so that nothing of the length of
the scores is repeated, exchanged or kept. The Column functions of
functions/metrics.py compute the same row by row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import FLOOR

CELLS = 1 << 16
KEYS = ("sample_id", "layer", "position")
NUMBERS = ("lse_term", "quadratic_term", "entropy", "norm_entropy", "js", "hellinger_sq")


def distributions(s: np.ndarray, beta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """softmax(beta * s) of each row, its entropy and the log-sum-exp term."""
    x = s * beta
    top = x.max(1, keepdims=True)
    x -= top
    np.maximum(x, -800.0, out=x)  # exp is 0 from there on; 0 times it is 0
    e = np.exp(x)
    z = e.sum(1)
    entropy = np.log(z) - np.einsum("ij,ij->i", e, x) / z
    e /= z[:, None]
    return e, entropy, -(top[:, 0] + np.log(z)) / beta


def divergences(p: np.ndarray, q: np.ndarray, p_entropy: np.ndarray, q_entropy: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """Jensen-Shannon divergence (nats), as the entropy of the mean less the mean
    of the entropies, and squared Hellinger distance of rows."""
    m = p + q
    m *= 0.5
    np.maximum(m, FLOOR, out=m)
    js = -np.einsum("ij,ij->i", m, np.log(m)) - (p_entropy + q_entropy) / 2
    d = np.sqrt(p) - np.sqrt(q)
    return np.maximum(js, 0.0), np.einsum("ij,ij->i", d, d) / 2


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, scores as a matrix): runs of rows with equally many scores."""
    scores = batch.column("scores")
    ends = scores.offsets.to_numpy().astype(np.int64)
    values = scores.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    lengths, start = np.diff(ends), 0
    while start < len(lengths):
        n = int(lengths[start])
        most = max(1, CELLS // max(1, n))
        same = lengths[start : start + most] == n
        stop = start + (len(same) if same.all() else int(np.argmin(same)))
        yield start, values[ends[start] : ends[stop]].reshape(stop - start, n)
        start = stop


def norm_entropies(rows: DataFrame, betas: tuple[float, ...], keys: tuple[str, ...]) -> DataFrame:
    """keys, beta, h: the normalised entropy of each row's scores at each beta.
    A row without scores gives NaN."""
    names = [*keys, "beta", "h"]

    def run(batches):
        for batch in batches:
            for start, s in _blocks(batch):
                own = [batch.column(k).slice(start, len(s)) for k in keys]
                for b in betas:
                    with np.errstate(invalid="ignore", divide="ignore"):
                        h = distributions(s, b)[1] / np.log(s.shape[1]) if s.shape[1] else np.full(len(s), np.nan)
                    yield pa.record_batch([*own, pa.array(np.full(len(s), b)), pa.array(h)], names)

    schema = rows.select(*keys).schema.add("beta", "double").add("h", "double")
    return rows.select(*keys, "scores").where(F.col("scores").isNotNull()).mapInArrow(run, schema)


def metric_rows(scored: DataFrame, betas: tuple[float, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """scored: keys, scores, and r or quadratic_term. KEYS, beta, keep, NUMBERS;
    one row for each row and beta. js and hellinger_sq are null at the reference
    (position 0) and where a (sample, layer) has none. Rows meet their reference
    in their task: they are shuffled on (sample, layer) once for all betas."""
    quadratic = "quadratic_term" if "quadratic_term" in scored.columns else "r"
    rows = scored.select(*KEYS, *keep, "scores", quadratic).where(F.col("scores").isNotNull())
    rows = rows.repartition("sample_id", "layer").sortWithinPartitions(*KEYS)
    names = [*KEYS, "beta", *keep, *NUMBERS]

    def run(batches):
        key, ref = None, {}
        for batch in batches:
            sample, layer = (batch.column(c).dictionary_encode().indices.to_numpy(zero_copy_only=False) for c in KEYS[:2])
            position = batch.column("position").to_numpy()
            for start, s in _blocks(batch):
                n = len(s)
                own = slice(start, start + n)
                new = np.r_[True, (np.diff(sample[own]) != 0) | (np.diff(layer[own]) != 0)]
                first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
                now = (batch.column("sample_id")[start].as_py(), batch.column("layer")[start].as_py())
                if key != now:
                    ref = {}
                key = (batch.column("sample_id")[start + n - 1].as_py(), batch.column("layer")[start + n - 1].as_py())
                has = position[own][first] == 0
                carried = ~has & (first == 0) & bool(ref)
                last = int(first[-1])
                q_term = batch.column(quadratic).slice(start, n)
                if quadratic == "r":
                    r = [np.asarray(x, float) for x in q_term.to_pylist()]
                    q_term = pa.array([float(x @ x) / 2 for x in r])
                same = [batch.column(c).slice(start, n) for c in KEYS]
                more = [batch.column(c).slice(start, n) for c in keep]
                for b in betas:
                    with np.errstate(invalid="ignore", divide="ignore"):
                        p, h, lse = distributions(s, b)
                        gen = (position[own] > 0) & (has | carried)
                        js, hellinger = np.zeros(n), np.zeros(n)
                        for mask, q in ((gen & has, None), (gen & carried, ref.get(b))):
                            if mask.any():
                                at = first[mask]
                                js[mask], hellinger[mask] = divergences(p[mask], p[at] if q is None else q[0][None], h[mask], h[at] if q is None else q[1])
                        norm = h / np.log(s.shape[1])
                    numbers = [pa.array(lse), q_term, pa.array(h), pa.array(norm), pa.array(js, mask=~gen), pa.array(hellinger, mask=~gen)]
                    yield pa.record_batch([*same, pa.array(np.full(n, b)), *more, *numbers], names)
                    if has[-1]:
                        ref[b] = p[last].copy(), h[last]
                    elif not carried[-1]:
                        ref.pop(b, None)

    schema = rows.select(*KEYS).schema.add("beta", "double")
    for c in keep:
        schema = schema.add(rows.schema[c])
    for c in NUMBERS:
        schema = schema.add(c, "double")
    return rows.mapInArrow(run, schema)

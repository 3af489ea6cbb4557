"""Logistic probes without leakage: medians, scales and weights come from the
rows of the fit alone.

All fits of a protocol step (folds and values of C, of one protocol or of many, such
as one per temperature) are made together by Newton's method: in each step one job
goes over the rows once, each task adds up gradients and Hessians of every fit, and
only their sums reach the driver."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .radix import medians, packed_sums
from .radix import packed as packed_table
from .splits import kfold
from .stats import auroc_by

C_GRID, INNER, OUTER, SMOKE = (0.01, 0.1, 1.0, 10.0), 3, 5, 30
STEPS, TOLERANCE, MOST_TASKS = 50, 1e-6, 20
#: Numbers that the driver adds up itself.
MOST_NUMBERS = 4_000_000


class Scaling:
    """Median imputation and standardisation by the population deviation (1 where
    that is 0) of one set of rows."""

    def __init__(self, medians: np.ndarray, means: np.ndarray, scales: np.ndarray):
        self.medians, self.means, self.scales = medians, means, scales

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """x (rows, columns), scaled, and a column of ones."""
        z = (np.where(np.isnan(x), self.medians, x) - self.means) / self.scales
        return np.concatenate([z, np.ones((len(z), 1))], 1)


def packed(rows: DataFrame, columns: list[str], sets: list[Column], keep: tuple[str, ...] = (), group: Column | None = None) -> DataFrame:
    """x (null is NaN), y, and m: the sets that the row is in. Each group, from 0, has
    its own sets; a row of group -1 is in none."""
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns])
    m = F.filter(F.array(*[F.when(s, F.lit(i)) for i, s in enumerate(sets)]), lambda v: v.isNotNull())
    if group is not None:
        m = F.when(group >= 0, F.transform(m, lambda v: v + group * len(sets))).otherwise(F.array().cast("array<int>"))
    return rows.select(*keep, x.alias("x"), F.col("y").cast("double").alias("y"), m.alias("m"))


def _columns(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """x, y, and the places of each set's rows."""
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
    m = batch.column("m")
    own, row = m.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(x)), np.diff(m.offsets.to_numpy()))
    order = np.argsort(own, kind="stable")
    sets, starts = np.unique(own[order], return_index=True)
    return x, batch.column("y").to_numpy(zero_copy_only=False), dict(zip(sets.tolist(), np.split(row[order], starts[1:]), strict=True)) if len(own) else {}


def _moments(x: np.ndarray) -> np.ndarray:
    """Of each column's numbers: how many, mean, and squared deviations."""
    ok = ~np.isnan(x)
    n = ok.sum(0)
    mean = np.where(ok, x, 0.0).sum(0) / np.maximum(n, 1)
    return np.stack([n, mean, (np.where(ok, x - mean, 0.0) ** 2).sum(0)])


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = np.maximum(a[0] + b[0], 1)
    d = b[1] - a[1]
    return np.stack([a[0] + b[0], a[1] + d * b[0] / n, a[2] + b[2] + d * d * a[0] * b[0] / n])


def scalings(data: DataFrame, k: int, sets: set[int] | None = None, few: bool = False) -> dict[int, Scaling]:
    """For each set (of `sets`) the Scaling of its rows. A task hands on one row per
    set; medians are found by their bits."""
    mine = lambda s: sets is None or s in sets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows_in = {}, {}
        for batch in batches:
            x, _, rows = _columns(batch, k)
            for s in filter(mine, rows):
                own = _moments(x[rows[s]])
                total[s], rows_in[s] = _joined(total[s], own) if s in total else own, rows_in.get(s, 0) + len(rows[s])
        yield from packed_table(list(total), [np.r_[rows_in[s], total[s].ravel()] for s in total]).to_batches()

    def unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        x, _, rows = _columns(batch, k)
        return x, rows

    found: dict[int, np.ndarray] = {}
    for batch in data.mapInArrow(run, "fit long, v array<double>").groupBy("fit").applyInArrow(_added_moments, "fit long, v array<double>").toArrow().to_batches():  # one row per set
        found |= {s: v.values.to_numpy() for s, v in zip(batch.column("fit").to_pylist(), batch.column("v"), strict=True)}
    counts = {s: v[1 : k + 1].astype(np.int64) for s, v in found.items()}
    median_of = medians(data, unpack, counts, few) if found else {}
    out = {}
    for s, v in found.items():
        n, (have, mean, squares), median = v[0], v[1:].reshape(3, k), median_of[s]
        # of the filled column: its other rows all hold the median
        whole = (have * mean + (n - have) * median) / n
        scale = np.sqrt((squares + have * (mean - whole) ** 2 + (n - have) * (median - whole) ** 2) / n)
        out[s] = Scaling(median, whole, np.where(scale > 0, scale, 1.0))
    return out


def _added_moments(table: pa.Table) -> pa.Table:
    parts = [np.asarray(v) for v in table.column("v").to_numpy()]
    total = parts[0][1:].reshape(3, -1)
    for v in parts[1:]:
        total = _joined(total, v[1:].reshape(3, -1))
    return packed_table([table.column("fit")[0].as_py()], [np.r_[sum(v[0] for v in parts), total.ravel()]])


def newton(data: DataFrame, k: int, fits: list[tuple[int, float]], scale: dict[int, Scaling], few: bool = False) -> list[np.ndarray]:
    """few: data has at most MOST_TASKS partitions. fits: (set, C). Weights and the intercept of each fit: the minimum of the
    summed log loss plus |weights|^2 / (2 C). Zeros for a set without rows."""
    w = [np.zeros(k + 1) for _ in fits]
    todo = [i for i, (s, _) in enumerate(fits) if s in scale]

    def step(now: list[np.ndarray], some: list[int]) -> dict[int, np.ndarray]:
        of: dict[int, list[int]] = {}
        for i in some:
            of.setdefault(fits[i][0], []).append(i)

        def run(batches):
            total = {i: np.zeros((k + 1) * (k + 2)) for i in some}
            for batch in batches:
                x, y, rows = _columns(batch, k)
                for s in of.keys() & rows.keys():
                    z, t = scale[s](x[rows[s]]), y[rows[s]]
                    for i in of[s]:
                        p = 1 / (1 + np.exp(-np.clip(z @ now[i], -500, 500)))
                        total[i] += np.concatenate([z.T @ (p - t), ((z * (p * (1 - p))[:, None]).T @ z).ravel()])
            yield from packed_table(list(total), list(total.values())).to_batches()

        return packed_sums(data.mapInArrow(run, "fit long, v array<double>"), few and MOST_TASKS * len(some) * (k + 1) * (k + 2) <= MOST_NUMBERS)

    for _ in range(STEPS):
        if not todo:
            break
        left = []
        for i, v in step(w, todo).items():
            penalty = np.r_[np.full(k, 1 / fits[i][1]), 0.0]
            change = np.linalg.lstsq(v[k + 1 :].reshape(k + 1, k + 1) + np.diag(penalty), v[: k + 1] + penalty * w[i], rcond=None)[0]
            w[i] = w[i] - change
            if np.abs(change).max() > TOLERANCE:
                left.append(int(i))
        todo = left
    return w


def scored(data: DataFrame, k: int, fits: list[tuple[int, float]], weights: list[np.ndarray], scale: dict[int, Scaling], held: dict[int, int], keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, fit, y, score of the rows in the set that a fit is held to; held:
    the fit's set to that one."""
    names = [*keep, "fit", "y", "score"]

    def run(batches):
        for batch in batches:
            x, y, rows_of = _columns(batch, k)
            for i, (s, _) in enumerate(fits):
                rows = rows_of.get(held[s], ())
                if s in scale and len(rows):
                    p = 1 / (1 + np.exp(-np.clip(scale[s](x[rows]) @ weights[i], -500, 500)))
                    yield pa.record_batch([*[batch.column(c).take(pa.array(rows)) for c in keep], pa.array(np.full(len(rows), i)), pa.array(y[rows].astype(np.int32)), pa.array(p)], names)

    return data.mapInArrow(run, data.select(*keep).schema.add("fit", "long").add("y", "integer").add("score", "double"))


class Probe:
    """One fit: Scaling, and logistic regression with an L2 penalty of 1 / (C n)
    on the mean loss."""

    def __init__(self, columns: list[str], c: float = 1.0):
        self.columns, self.c = columns, c

    def fit(self, rows: DataFrame) -> Probe:
        data, k = packed(rows, self.columns, [F.lit(True)]), len(self.columns)
        self.scale = scalings(data, k)
        self.weights = newton(data, k, [(0, self.c)], self.scale)
        return self

    def scores(self, rows: DataFrame, keep: tuple[str, ...] = ("sample_id",)) -> DataFrame:
        """keep, y, score."""
        data = packed(rows.withColumn("y", F.coalesce("y", F.lit(-1))), self.columns, [F.lit(True)], keep)
        return scored(data, len(self.columns), [(0, self.c)], self.weights, self.scale, {0: 0}, keep).select(*keep, F.when(F.col("y") >= 0, F.col("y")).alias("y"), "score")


def task_count(rows: DataFrame, per_task: int = 50_000) -> int:
    """Partitions for a protocol's rows, which runs a job for each of its steps."""
    return max(1, rows.count() // per_task)


def compact(rows: DataFrame, per_task: int = 50_000) -> DataFrame:
    """Few rows in few partitions. They are shuffled to these: coalesced, a task would
    do the joins and sorts before it for many partitions and hold their memory."""
    n = task_count(rows, per_task)
    return rows.repartition(n) if n < MOST_TASKS else rows


def _aurocs(rows: DataFrame) -> dict[int, float]:
    """AUROC by fit, of those with both classes."""
    return {r["fit"]: r["auroc"] for r in auroc_by(rows, ["fit"]).collect() if r["auroc"] is not None}  # one row per fit


def _mean(values: list[float]) -> float:
    return sum(values) / len(values) if values else math.nan


def run_protocol(rows: DataFrame, columns: list[str], grid: tuple[float, ...] = C_GRID, inner: int = INNER, outer: int = OUTER, seed: int = 42, fitted: Callable[[DataFrame], None] | None = None) -> dict:
    """rows: sample_id, y, split and the columns. C is chosen by inner folds on
    train (the first in the grid on ties), checked by outer folds on train and
    val, refitted there, and tested once. Returns best_c, inner (mean AUROC by C),
    outer_mean, outer_std (population), test_auroc, test (a DataFrame) and n_fits.
    `fitted` gets the rows of each fit."""
    one = rows.withColumn("_one", F.lit(0))
    return run_protocols(one, columns, "_one", [0], grid, inner, outer, seed, fitted)[0]


def run_protocols(rows: DataFrame, columns: list[str], by: str, groups: list, grid: tuple[float, ...] = C_GRID, inner: int = INNER, outer: int = OUTER, seed: int = 42, fitted: Callable[[DataFrame], None] | None = None) -> dict:
    """run_protocol() on the rows of each of the groups (values of `by`), by group.
    The fits of all groups are made together, so that there are as many jobs as for
    one."""
    tasks = task_count(rows)
    few = tasks <= MOST_TASKS
    none = lambda d, c: d.withColumn(c, F.lit(None).cast("int"))
    both = kfold(rows.where("split = 'train'"), inner, seed, "_inner", (by,)).unionByName(none(rows.where("split <> 'train'"), "_inner"))
    both = kfold(both.where("split in ('train', 'val')"), outer, seed, "_outer", (by,)).unionByName(none(both.where("split = 'test'"), "_outer"))
    train, fit_rows, k = F.col("split") == "train", F.col("split").isin("train", "val"), len(columns)
    # sets to fit on, then those that these are held to
    fit_sets = [*[train & (F.col("_inner") != i) for i in range(inner)], *[fit_rows & (F.col("_outer") != i) for i in range(outer)], fit_rows]
    held_sets = [*[train & (F.col("_inner") == i) for i in range(inner)], *[fit_rows & (F.col("_outer") == i) for i in range(outer)], F.col("split") == "test"]
    half = len(fit_sets)
    set_of = lambda g, i: 2 * half * g + i
    held = {set_of(g, i): set_of(g, half + i) for g in range(len(groups)) for i in range(half)}
    data = packed(both, columns, fit_sets + held_sets, ("sample_id",), _place(by, groups)).repartition(tasks, "sample_id").persist()  # coalesced, a task would do the joins and sorts of many
    scale = scalings(data, k, set(held), few)

    def run(fits: list[tuple[int, float]]) -> DataFrame:
        if fitted:
            for s, _ in fits:
                fitted(both.where((F.col(by) == F.lit(groups[s // (2 * half)])) & fit_sets[s % (2 * half)]))
        return scored(data, k, fits, newton(data, k, fits, scale, few), scale, held, ("sample_id",))

    first = [(g, i, c) for g in range(len(groups)) for c in grid for i in range(inner)]
    got = _aurocs(run([(set_of(g, i), c) for g, i, c in first]))
    means = [{c: _mean([got[j] for j, (at, _, own) in enumerate(first) if (at, own) == (g, c) and j in got]) for c in grid} for g in range(len(groups))]
    best = [max(grid, key=lambda c, m=m: (m[c] if not math.isnan(m[c]) else -1, -grid.index(c))) for m in means]
    made = run([(set_of(g, inner + i), best[g]) for g in range(len(groups)) for i in range(outer + 1)])
    got = _aurocs(made)
    data.unpersist()  # `test` reads the rows again
    out = {}
    for g, v in enumerate(groups):
        start = g * (outer + 1)
        folds = [got[start + i] for i in range(outer) if start + i in got]
        mean = _mean(folds)
        out[v] = {
            "best_c": best[g], "inner": means[g], "outer_mean": mean, "outer_std": math.sqrt(_mean([(x - mean) ** 2 for x in folds])) if folds else math.nan,
            "test_auroc": got.get(start + outer), "test": made.where(F.col("fit") == start + outer).drop("fit"), "n_fits": len(grid) * inner + outer + 1,
        }
    return out


def _place(by: str, groups: list) -> Column:
    """The place of the row's value of `by` in groups, or -1."""
    return F.coalesce(*[F.when(F.col(by) == F.lit(v), F.lit(g)) for g, v in enumerate(groups)], F.lit(-1))


def run_base_and_full(rows: DataFrame, base: list[str], phi: list[str], **how) -> dict:
    """The same protocol on the baselines, and on baselines and features; with
    fewer than SMOKE labelled rows, one in-sample fit each."""
    rows = rows.where(F.col("y").isNotNull())
    if rows.count() < SMOKE:
        return {name: in_sample(rows, columns) for name, columns in (("base", base), ("full", base + phi))}
    return {name: run_protocol(rows, columns, **how) for name, columns in (("base", base), ("full", base + phi))}


def in_sample(rows: DataFrame, columns: list[str], c: float = 1.0) -> dict:
    """One fit on all rows and its AUROC on the same; NaN with one class."""
    rows = compact(rows)
    if rows.select("y").distinct().count() < 2:
        return {"best_c": c, "test_auroc": math.nan, "smoke": True}
    made = Probe(columns, c).fit(rows).scores(rows)
    return {"best_c": c, "test_auroc": _aurocs(made.withColumn("fit", F.lit(0))).get(0), "test": made, "smoke": True}


def in_samples(rows: DataFrame, columns: list[str], by: str, groups: list, c: float = 1.0) -> dict:
    """AUROC by group (value of `by`) of one fit on all its rows; groups of one class
    have none. The fits are made together."""
    data = packed(compact(rows), columns, [F.lit(True)], ("sample_id",), _place(by, groups)).persist()
    fits, scale = [(g, c) for g in range(len(groups))], scalings(data, len(columns))
    got = _aurocs(scored(data, len(columns), fits, newton(data, len(columns), fits, scale), scale, {g: g for g, _ in fits}))
    data.unpersist()
    return {v: got[g] for g, v in enumerate(groups) if g in got}

"""Quality scores by Bradley-Terry pairwise ranking (operator 2).

A document's worth is a linear function of text statistics. Each preference
pair (a document labelled good, one labelled bad) is an observation that the
first one wins, with probability sigmoid(worth(a) - worth(b)): logistic
regression on feature differences without an intercept. All pairs would be
quadratic; every labelled row is compared with PER_ROW rows of the other kind.

Learning takes every labelled row, in tasks. Rows are dealt by hash into buckets of
some BUCKET, which is one row of a written table, and draw their opposites in it; of
a kind that is rare, each bucket gets LEAST or so, as copies that draw none. A Newton
step is one job that adds up gradients and Hessians in whole numbers (of 1 / UNIT),
so that the order of tasks does not matter. The threshold is chosen from counts of
all labelled rows in CELLS cells of worth, between those below which 0.5 and 1.2
times the share that the labels call bad lie: the edge with the least cost, a good
row below it costing GOOD_COST times as much as a bad row above it (the middle one
of neighbours that cost the same). A score is that worth mapped so that the
threshold lands on 0.3.

Statistics are made in one pass over the texts; every document is scored.

Defined results: null and empty texts are scored by their statistics (all
zero); label rows that are null, or whose document is missing, are not learned;
a document with several labels counts once for each; of several documents with
one doc_id, that with the least text is learned; without both kinds of labels
every score is 0.5. Repeated rows get equal scores; further columns do not
matter to quality_scores() and pass through keep_good().
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, pieces_of, remainder
from .textstats import RATIOS, counts, ratios, with_stats

PAIRS = 200_000
PER_ROW, BUCKET, LEAST = 10, 4096, 64
UNIT, CELLS = 1 << 24, 1 << 14
THRESHOLD = 0.3
QUANTILES, GOOD_COST = (0.5, 1.2, 71), 4
HELD_OUT = (5, 0)


def _wide(x: np.ndarray) -> np.ndarray:
    """The ratios, their square roots (which tell small shares apart) and the
    distance of the lengths from the middle."""
    return np.concatenate([x, np.sqrt(np.abs(x))], axis=1)


def learn(x: np.ndarray, good: np.ndarray, seed: int = 5, steps: int = 60, pairs: int = PAIRS) -> dict:
    """The same for rows at hand, from pairs drawn among all of them; queries learn
    by learn_all(). x: ratios (n, features)."""
    model = {"center": np.zeros(2 * len(RATIOS)), "scale": np.ones(2 * len(RATIOS)), "weight": np.zeros(2 * len(RATIOS)), "at": 0.0}
    first, second = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(first) or not len(second):
        return model | {"at": None}
    z = _wide(x)
    model["center"], model["scale"] = z.mean(0), np.maximum(z.std(0), 1e-9)
    z = np.clip((z - model["center"]) / model["scale"], -8, 8)
    rng = np.random.default_rng(seed)
    n = min(pairs, 20 * (len(first) + len(second)))
    d = z[rng.choice(first, n)] - z[rng.choice(second, n)]
    w, ridge = np.zeros(d.shape[1]), 1e-3 * n
    for _ in range(steps):
        g, h = _terms(d, w, np.ones(n))
        step = np.linalg.solve(h + ridge * np.eye(len(w)), g - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return model | {"weight": w, "at": threshold(z @ w, good)}


def _terms(d: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and negative Hessian of the log-likelihood of pairs, each n times."""
    p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
    return d.T @ ((1 - p) * n), (d * (p * (1 - p) * n)[:, None]).T @ d


def threshold(worth: np.ndarray, good: np.ndarray) -> float:
    """The quantile of the worths that separates best (see above)."""
    low, high, n = QUANTILES
    cuts = np.quantile(worth, np.clip(np.linspace(low, high, n) * (1 - good.mean()), 0, 1))
    costs = [GOOD_COST * (worth[good] < c).sum() + (worth[~good] >= c).sum() for c in cuts]
    return float(cuts[int(np.argmin(costs))])


def score(model: dict, x: np.ndarray) -> np.ndarray:
    if model["at"] is None:
        return np.full(len(x), 0.5)
    z = np.clip((_wide(x) - model["center"]) / model["scale"], -8, 8)
    shift = z @ model["weight"] - model["at"] + math.log(THRESHOLD / (1 - THRESHOLD))
    return 1 / (1 + np.exp(-np.clip(shift, -40, 40)))


class Bucket(NamedTuple):
    """Labelled rows: ratios, whether good, how many labels of that kind, and whether
    the row is no copy."""

    number: int
    x: np.ndarray
    good: np.ndarray
    n: np.ndarray
    own: np.ndarray

    def pairs(self, model: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Differences good less bad and their number, as rows draw opposites: the
        same ones whenever this is asked."""
        z, rng = _standard(model, self.x), np.random.default_rng([5, self.number])
        for kind in (True, False):
            mine, other = np.flatnonzero(self.own & (self.good == kind)), np.flatnonzero(self.good != kind)
            if len(mine) and len(other):
                mine, upto = np.repeat(mine, PER_ROW), np.cumsum(self.n[other])
                d = z[mine] - z[other[np.searchsorted(upto, rng.integers(upto[-1], size=len(mine)), side="right")]]
                yield d if kind else -d, self.n[mine]


def _standard(model: dict, x: np.ndarray) -> np.ndarray:
    return np.clip((_wide(x) - model["center"]) / model["scale"], -8, 8)


def labelled_stats(docs: DataFrame, stats: DataFrame, labels: DataFrame, only: Column) -> DataFrame:
    """doc_id, quality, n (label rows), ratios of every label row where `only` holds,
    written. stats: a row with doc_id and ratios for each of docs."""
    given = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & only).groupBy("doc_id", F.col("quality").cast("int").alias("quality")).agg(F.count("*").alias("n"))
    stats = stats.select("doc_id", "ratios")
    twice = materialize(stats.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"))
    if not twice.isEmpty():
        texts = docs.select("doc_id", "text").join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
        stats = stats.join(twice, "doc_id", "left_anti").unionByName(with_stats(texts).select("doc_id", "ratios"))
    return materialize(given.join(stats, "doc_id"))


def labelled_ratios(docs: DataFrame, labels: DataFrame, sample: int, only: Column) -> tuple[np.ndarray, np.ndarray]:
    """Ratios and labels of at most `sample` label rows where `only` holds, here: to
    look at, or for learn()."""
    rows = labelled_stats(docs, with_stats(docs), labels, only)
    rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("n")))).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample).select("quality", "ratios").toPandas()
    return np.array(rows["ratios"].tolist(), float).reshape(-1, len(RATIOS)), rows["quality"].to_numpy(int) == 1


def buckets(rows: DataFrame) -> DataFrame | None:
    """rows: labelled_stats(). A written row for each Bucket; None without both kinds."""
    found = {r["quality"]: r["count"] for r in rows.groupBy("quality").count().collect()}  # two rows
    if len(found) < 2:
        return None
    n = -(-sum(found.values()) // BUCKET)
    rare = min(found, key=lambda q: (found[q], q))
    copies = min(n, max(1, -(-LEAST * n // found[rare])))
    each = F.explode(F.sequence(F.lit(0), F.when(F.col("quality") == rare, copies - 1).otherwise(0)))
    dealt = rows.withColumn("copy", each).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "quality") + F.col("copy"), F.lit(n)).cast("int"))

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("quality", "ascending"), ("copy", "ascending")]).combine_chunks()
        x = group.column("ratios").combine_chunks().flatten().to_numpy()
        parts = [x, group.column("quality").to_numpy() == 1, group.column("n").to_numpy(), group.column("copy").to_numpy() == 0]
        return pa.table({"bucket": group.column("bucket").slice(0, 1), **{c: pa.array([p.tobytes()], pa.binary()) for c, p in zip(("x", "good", "n", "own"), parts, strict=True)}})

    return materialize(dealt.groupBy("bucket").applyInArrow(pack, "bucket int, x binary, good binary, n binary, own binary"))


def _buckets_in(batches: Iterator[pa.RecordBatch]) -> Iterator[Bucket]:
    for batch in batches:
        for b in batch.to_pylist():
            yield Bucket(b["bucket"], np.frombuffer(b["x"]).reshape(-1, len(RATIOS)), *[np.frombuffer(b[c], t) for c, t in (("good", bool), ("n", np.int64), ("own", bool))])


def _center_and_scale(packed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    def moments(batches):
        for b in _buckets_in(batches):
            z, n = _wide(b.x[b.own]), b.n[b.own]
            mean = n @ z / max(1, n.sum())
            yield pa.record_batch([pa.array([v]) for v in (b.number, int(n.sum()), mean, n @ (z - mean) ** 2)], ["bucket", "n", "mean", "squares"])

    rows = packed.mapInArrow(moments, "bucket long, n long, mean array<double>, squares array<double>").orderBy("bucket").collect()  # a row per bucket
    total, mean, squares = 0, np.zeros(2 * len(RATIOS)), np.zeros(2 * len(RATIOS))
    for r in (r for r in rows if r["n"]):
        d, all_ = np.array(r["mean"]) - mean, total + r["n"]
        squares += np.array(r["squares"]) + d * d * (total * r["n"] / all_)
        total, mean = all_, mean + d * (r["n"] / all_)
    return mean, np.maximum(np.sqrt(squares / max(1, total)), 1e-9)


def learn_all(rows: DataFrame, steps: int = 60) -> dict:
    """rows: labelled_stats(). The model, from all of them."""
    k, packed = 2 * len(RATIOS), buckets(rows)
    if packed is None:
        return {"center": np.zeros(k), "scale": np.ones(k), "weight": np.zeros(k), "at": None}
    center, scale = _center_and_scale(packed)
    model = {"center": center, "scale": scale, "weight": np.zeros(k)}

    def terms(batches):
        total = np.zeros(1 + k + k * k, np.int64)
        for b in _buckets_in(batches):
            for d, n in b.pairs(model):
                g, h = _terms(d, model["weight"], n)
                total += np.rint(np.concatenate([[n.sum()], g, h.ravel()]) * UNIT).astype(np.int64)
        yield pa.record_batch([pa.array([total])], ["total"])

    for _ in range(steps):
        total = sum(np.array(r["total"], np.int64) for r in packed.mapInArrow(terms, "total array<long>").collect()) / UNIT  # a row per task
        w, ridge = model["weight"], 1e-3 * total[0]
        step = np.linalg.solve(total[1 + k :].reshape(k, k) + ridge * np.eye(k), total[1 : 1 + k] - ridge * w)
        model = model | {"weight": w + step}
        if np.abs(step).max() < 1e-6:
            break
    return model | {"at": threshold_of_all(packed, model)}


def worths(packed: DataFrame, model: dict, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of bad and good rows below `low`, in CELLS cells up to `high`, and
    from there on."""

    def count(batches):
        n = np.zeros((2, CELLS + 2), np.int64)
        for b in _buckets_in(batches):
            worth = _standard(model, b.x[b.own]) @ model["weight"]
            cell = np.clip(np.floor((worth - low) / (high - low) * CELLS), -1, CELLS).astype(np.int64) + 1
            np.add.at(n, (b.good[b.own].astype(int), cell), b.n[b.own])
        cells = np.flatnonzero(n.any(0))
        yield pa.record_batch([pa.array(v) for v in (cells, *n[:, cells])], ["cell", "bad", "good"])

    rows = packed.mapInArrow(count, "cell long, bad long, good long").groupBy("cell").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toPandas()  # a row per cell
    out = np.zeros((2, CELLS + 2), np.int64)
    out[:, rows["cell"]] = rows[["bad", "good"]].to_numpy().T
    return out[0], out[1]


def threshold_of_all(packed: DataFrame, model: dict) -> float:
    """The worth that separates all labelled rows best (see above)."""
    far = 8 * float(np.abs(model["weight"]).sum()) + 1e-6
    low, high = -far, far
    for finest in (False, False, True):
        bad, good = worths(packed, model, low, high)
        edges = low + (high - low) * np.arange(CELLS + 1) / CELLS
        below = np.cumsum(bad + good)[:-1]  # rows under each edge
        wanted = np.clip(np.array(QUANTILES[:2]) * bad.sum(), 0, (bad + good).sum())
        first, last = int(np.searchsorted(below, wanted[0], "right")) - 1, int(np.searchsorted(below, wanted[1]))
        first, last = max(0, first), min(CELLS, max(last, first + 1))
        if not finest:
            low, high = edges[first], edges[last]
    cost = (GOOD_COST * np.cumsum(good)[:-1] + bad.sum() - np.cumsum(bad)[:-1])[first : last + 1]
    at = first + int(np.argmin(cost))
    run = np.flatnonzero(cost[at - first :] != cost[at - first])
    return float(edges[at + (int(run[0]) if len(run) else last + 1 - at) // 2])


def _not_held_out() -> Column:
    return remainder(F.col("doc_id"), HELD_OUT[0]) != HELD_OUT[1]


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted."""
    stats = materialize(with_stats(docs).select("doc_id", "ratios"))
    model = learn_all(labelled_stats(docs, stats, labels, _not_held_out()))

    def run(batches):
        for batch in batches:
            x = batch.column("ratios").flatten().to_numpy().reshape(-1, len(RATIOS))
            yield pa.record_batch([batch.column("doc_id"), pa.array(score(model, x))], ["doc_id", "score"])

    scored = stats.mapInArrow(run, docs.select("doc_id").schema.add("score", "double"))
    return scored.select("doc_id", (~_not_held_out()).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def with_scores(docs: DataFrame, model: dict, keep: tuple[str, ...], name: str) -> DataFrame:
    """The columns in `keep` and the score."""

    def run(batches):
        for batch in batches:
            for part in pieces_of(batch, rows=4096):
                rows = [ratios(t, *counts(t)) for t in (x or "" for x in part.column("text").to_pylist())]
                yield pa.record_batch([*[part.column(c) for c in keep], pa.array(score(model, np.array(rows, float)))], [*keep, name])

    return docs.mapInArrow(run, docs.select(*keep).schema.add(name, "double"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose score reaches the threshold; columns as in docs."""
    stats = materialize(with_stats(docs.where(_not_held_out())).select("doc_id", "ratios"))
    model = learn_all(labelled_stats(docs, stats, labels, _not_held_out()))
    name = "_qr_score"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return with_scores(docs, model, tuple(docs.columns), name).where(F.col(name) >= THRESHOLD).drop(name)


def op2_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))

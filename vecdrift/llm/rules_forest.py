"""Quality rules with an isolation forest on rule statistics (operator 9).

A tree splits a random statistic at a random value until a sample row stands
alone; rows that are unusual are alone early. The anomaly of a document is
2 ** (-mean path length / expected path length). Two fixed rules fail a document
outright; of the others, those whose anomaly is above a threshold go. The forest
sees the four counted rules as ratios and four statistics that tell rows labelled
bad apart. As trees draw their statistics at random, a row that is odd in one of
them only is rarely odd enough.

Each tree grows in a task of its own, on 256 rows drawn by hash from all labelled
ones (a document with labels of both kinds is a row for each; several of one kind are
one). The threshold is calibrated on counts of every labelled row in CELLS cells of
anomaly: of the edges that keep 95 % to all of the good rows, the one with the fewest
errors, those on good rows weighing more. Statistics are made in one pass over the
texts, and every document is judged by them.

Defined results: a null text has no words and fails the rules, as does an
empty one; without labels, no document is anomalous. Repeated rows are judged
alike; further columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize
from .quality_rank import labelled_stats
from .simhash import spread
from .textstats import COUNTS, RATIOS, with_stats

CELLS = 1 << 16
TREES, PER_TREE, DEPTH = 200, 256, 10
WEIGHT = 4.0
#: The statistics that the forest sees.
RULES = ("word_length", "symbols", "dup_lines", "repeats", "upper", "exclamations", "bars", "distinct")


def _expected(n):
    n = np.maximum(np.asarray(n, float), 2)
    return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def fit(x: np.ndarray, trees: int = TREES, per_tree: int = PER_TREE, depth: int = DEPTH, seed: int = 9) -> dict:
    """The forest on rows at hand; the query's comes from fit_all(). Trees as arrays
    (tree, node), see grow()."""
    rng = np.random.default_rng(seed)
    grown = [grow(x[rng.choice(len(x), min(per_tree, len(x)), replace=False)], rng, depth) for _ in range(trees)]
    return _forest(grown, min(per_tree, len(x)), depth)


def _forest(grown: list, n: int, depth: int) -> dict:
    what, value, length = map(np.array, zip(*grown, strict=True))
    return {"what": what, "value": value, "length": length, "expected": float(_expected(n)), "depth": depth}


def grow(x: np.ndarray, rng: np.random.Generator, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tree by node: the statistic (-1: a leaf), the value, and the path length at a
    leaf. The children of node i are 2i+1 and 2i+2."""
    nodes = 2 ** (depth + 1) - 1
    what, value, length = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
    todo = [(0, 0, x)]
    while todo:
        node, level, rows = todo.pop()
        low, high = rows.min(0), rows.max(0)
        usable = np.flatnonzero(high > low)
        if level == depth or len(rows) <= 1 or not len(usable):
            length[node] = level + (float(_expected(len(rows))) if len(rows) > 1 else 0.0)
            continue
        f = rng.choice(usable)
        cut = rng.uniform(low[f], high[f])
        what[node], value[node] = f, cut
        left = rows[:, f] < cut
        todo += [(2 * node + 1, level + 1, rows[left]), (2 * node + 2, level + 1, rows[~left])]
    return what, value, length


def _seen(ratios: pa.Array) -> np.ndarray:
    x = ratios.flatten().to_numpy().reshape(-1, len(RATIOS))
    return np.ascontiguousarray(x[:, [RATIOS.index(r) for r in RULES]])


def fit_all(rows: DataFrame, trees: int = TREES, per_tree: int = PER_TREE, depth: int = DEPTH, seed: int = 9) -> dict | None:
    """rows: labelled_stats(). A tree gets the per_tree rows of least hash; about
    twice as many are sent to it. None without rows."""
    n = rows.count()
    if not n:
        return None
    below = np.uint64(min(1.0, 2 * per_tree / n) * float((1 << 64) - (1 << 12)))

    def draw(batches):
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                h = spread(part.column("u").to_numpy().view(np.uint64), trees)
                row, tree = np.nonzero(h <= below) if n > 2 * per_tree else np.indices(h.shape).reshape(2, -1)
                x = _seen(part.column("ratios"))[row]
                yield pa.record_batch([pa.array(tree.astype(np.int32)), pa.array((h[row, tree] >> np.uint64(1)).astype(np.int64)), pa.array(list(x), pa.list_(pa.float64()))], ["tree", "h", "x"])

    def plant(group: pa.Table) -> pa.Table:
        group = group.sort_by("h").slice(0, per_tree).combine_chunks()
        tree = group.column("tree")[0].as_py()
        x = group.column("x").combine_chunks().flatten().to_numpy().reshape(len(group), -1)
        grown = grow(x, np.random.default_rng([seed, tree]), depth)
        return pa.table({"tree": group.column("tree").slice(0, 1), **{c: pa.array([v.tolist()]) for c, v in zip(("what", "value", "length"), grown, strict=True)}})

    drawn = rows.select(F.xxhash64("doc_id", "quality").alias("u"), "ratios").mapInArrow(draw, "tree int, h long, x array<double>")
    grown = drawn.groupBy("tree").applyInArrow(plant, "tree int, what array<long>, value array<double>, length array<double>").orderBy("tree").collect()  # a row per tree
    return _forest([[np.array(g[c]) for c in ("what", "value", "length")] for g in grown], min(per_tree, n), depth)


def anomaly(forest: dict, x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for what, value, length in zip(forest["what"], forest["value"], forest["length"], strict=True):
        node = np.zeros(len(x), np.int64)
        for _ in range(forest["depth"]):
            f = what[node]
            right = x[rows, np.maximum(f, 0)] >= value[node]
            node = np.where(f >= 0, 2 * node + 1 + right, node)
        total += length[node]
    return 2.0 ** (-total / len(forest["what"]) / forest["expected"])


def calibrate(forest: dict, x: np.ndarray, good: np.ndarray, weight: float = WEIGHT) -> float:
    """The anomaly above which documents go: of the cuts that keep 95 % to all
    of the good rows, the one with the fewest errors, a good row that goes
    counting `weight` times."""
    if not good.any() or good.all():
        return 1.0
    a = anomaly(forest, x)
    cuts = np.quantile(a[good], np.append(np.linspace(0.95, 0.999, 50), 1.0))
    return float(min(cuts, key=lambda c: (weight * (a[good] > c).sum() + (a[~good] <= c).sum(), -c)))


def calibrate_all(forest: dict, rows: DataFrame, weight: float = WEIGHT) -> float:
    """The same from counts of all rows (labelled_stats()) by cells of anomaly."""

    def count(batches):
        n = np.zeros((2, CELLS), np.int64)
        for batch in batches:
            cell = np.minimum(anomaly(forest, _seen(batch.column("ratios"))) * CELLS, CELLS - 1).astype(np.int64)
            np.add.at(n, (batch.column("quality").to_numpy(), cell), batch.column("n").to_numpy())
        cells = np.flatnonzero(n.any(0))
        yield pa.record_batch([pa.array(v) for v in (cells, *n[:, cells])], ["cell", "bad", "good"])

    found = rows.select("quality", "n", "ratios").mapInArrow(count, "cell long, bad long, good long").groupBy("cell").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toPandas()  # a row per cell
    bad, good = np.zeros(CELLS, np.int64), np.zeros(CELLS, np.int64)
    bad[found["cell"]], good[found["cell"]] = found["bad"], found["good"]
    if not good.any() or not bad.any():
        return 1.0
    kept, caught = np.cumsum(good), bad.sum() - np.cumsum(bad)  # if cells up to this one stay
    first, last = int(np.argmax(kept >= 0.95 * good.sum())), int(np.argmax(kept == good.sum()))
    cost = (weight * (good.sum() - kept) + bad.sum() - caught)[first : last + 1]
    at = last - int(np.argmin(cost[::-1]))
    return float(np.nextafter((at + 1) / CELLS, 0))


def rule_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, COUNTS, base_failed, anomaly, kept."""
    stats = materialize(with_stats(docs))
    labelled = labelled_stats(docs, stats, labels, F.lit(True))
    forest = fit_all(labelled)
    limit = calibrate_all(forest, labelled) if forest else 1.0
    names = ["doc_id", *COUNTS, "base_failed", "anomaly", "kept"]

    def run(batches):
        for batch in batches:
            words, repeats = (batch.column(c).to_numpy() for c in ("n_words", "n_repeat_words"))
            failed = (words < 10) | (100 * repeats > 20 * words)
            a = anomaly(forest, _seen(batch.column("ratios"))) if forest else np.zeros(len(words))
            yield pa.record_batch([*[batch.column(c) for c in names[:-3]], pa.array(failed), pa.array(a), pa.array(~failed & (a <= limit))], names)

    schema = docs.select("doc_id").schema
    for c in COUNTS:
        schema = schema.add(c, "long")
    schema = schema.add("base_failed", "boolean").add("anomaly", "double").add("kept", "boolean")
    return stats.mapInArrow(run, schema)


def op9_rules_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))

"""Resampling inside tasks: replicates are computed where they are drawn, and only
their statistics leave the task.

Draws are the md5 numbers of (seed, replicate, attempt, place), as in stats.draws(),
so that reruns and engines agree; they are made many at once (functions/digests.py).
Up to KERNEL_ROWS rows, their labels and places in the order of scores go to every
task, and a replicate is one count of places. Beyond, rows stay
where a sort by score puts them; a row's weight in a replicate is a Poisson number
of mean 1, keyed by (seed, attempt, replicate, idx), which is what drawing with
replacement comes to for that many rows: all columns see the same weights, and a
task hands on three numbers per replicate."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.digests import Keys, digests, heads

KERNEL_ROWS, MOST_REDRAWS = 4_000_000, 1000
BLOCK = 64


def keyed_numbers(prefix: str, keys: list[bytes]) -> np.ndarray:
    """60 bits of md5 of prefix and each key: metrics.keyed_number() of many."""
    start, out = hashlib.md5(prefix.encode()), bytearray()
    for k in keys:
        h = start.copy()
        h.update(k)
        out += h.digest()[:8]
    return (np.frombuffer(bytes(out), ">u8") >> np.uint64(4)).astype(np.int64)


class Ranked:
    """Labels in the order of one column, and where its groups of ties begin."""

    def __init__(self, y: np.ndarray, values: np.ndarray):
        self.order = np.argsort(values, kind="stable").astype(np.int32)  # NaN last
        ordered = values[self.order]
        new = (ordered[1:] != ordered[:-1]) & ~(np.isnan(ordered[1:]) & np.isnan(ordered[:-1]))
        self.starts = np.flatnonzero(np.r_[True, new]) if len(values) else np.zeros(0, np.int64)
        self.positive, self.nan = y[self.order] == 1, np.isnan(ordered)

    def auroc(self, weight: np.ndarray) -> float:
        w = weight[self.order]
        if w[self.nan].any():
            return math.nan
        pos, neg = np.add.reduceat(w * self.positive, self.starts), np.add.reduceat(w * ~self.positive, self.starts)
        less = np.cumsum(neg) - neg
        return float((pos * (less + neg / 2)).sum() / (int(pos.sum()) * int(neg.sum())))


def replicates(rows: DataFrame, columns: tuple[str, ...], n_bootstrap: int, seed: int = 42, kernel_rows: int = KERNEL_ROWS, most_redraws: int = MOST_REDRAWS) -> DataFrame:
    """rows: idx (from 0), y, and columns of scores. b, and the AUROC of each column
    on the same draw of as many rows. A draw with one class is made again, most_redraws
    times at most; then, or if rows don't hold both classes, it is an error. Rows
    with a null label or score are drawn, but do not count."""
    usable = F.col("y").isNotNull()
    for c in columns:
        usable = usable & F.col(c).isNotNull()
    rows = rows.select("idx", F.when(usable, F.col("y").cast("int")).alias("y"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    n, classes = rows.agg(F.count("*"), F.count_distinct("y")).first()
    if classes < 2:
        raise ValueError("a bootstrap needs rows of both classes")
    way = _from_ranks if n <= kernel_rows else _from_weights
    return way(rows, columns, n_bootstrap, seed, most_redraws)


def _from_ranks(rows: DataFrame, columns: tuple[str, ...], n_bootstrap: int, seed: int, most_redraws: int) -> DataFrame:
    spark = rows.sparkSession
    data = rows.orderBy("idx").toPandas()  # at most KERNEL_ROWS rows
    y = data["y"].fillna(-1).to_numpy(np.int8)
    known = spark.sparkContext.broadcast((y, [data[c].to_numpy(float) for c in columns]))

    def run(batches):
        y, values = known.value
        n, used = len(y), np.flatnonzero(y >= 0)
        ranked = [Ranked(y[used], v[used]) for v in values]
        places, draw = Keys.numbers(n), np.empty(n, np.int64)
        for batch in batches:
            out: list[list[float]] = [[] for _ in columns]
            for b in batch.column("b").to_pylist():
                for a in range(most_redraws + 1):
                    np.remainder(heads(f"{seed}:{b}:{a}:", places), n, out=draw)
                    weight = np.bincount(draw, minlength=n)[used]
                    positive = weight[y[used] == 1].sum()
                    if 0 < positive < weight.sum():
                        break
                else:
                    raise ValueError(f"no draw of both classes in {most_redraws + 1} attempts")
                for own, r in zip(out, ranked, strict=True):
                    own.append(r.auroc(weight))
            yield pa.record_batch([batch.column("b"), *[pa.array(v, pa.float64()) for v in out]], ["b", *columns])

    tasks = spark.sparkContext.defaultParallelism
    return spark.range(n_bootstrap).withColumnRenamed("id", "b").repartition(min(n_bootstrap, 4 * tasks)).mapInArrow(run, "b long, " + ", ".join(f"`{c}` double" for c in columns))


#: Chances that a Poisson number of mean 1 is at most 0, 1, 2, ...
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(19)])


def weights(seed: int, attempt: int, b: np.ndarray, idx: np.ndarray) -> np.ndarray:
    """(replicates, rows) of Poisson numbers, a mixed 64-bit number each."""
    key = int.from_bytes(hashlib.md5(f"{seed}:{attempt}".encode()).digest()[:8])
    with np.errstate(over="ignore"):
        x = (b.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(key))[:, None] ^ (idx.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
        x ^= x >> np.uint64(31)
    return np.searchsorted(_POISSON, (x >> np.uint64(11)) * 2.0**-53)


def _from_weights(rows: DataFrame, columns: tuple[str, ...], n_bootstrap: int, seed: int, most_redraws: int) -> DataFrame:
    spark, used = rows.sparkSession, rows.where("y is not null")
    tasks = spark.sparkContext.defaultParallelism

    def sums(wanted: np.ndarray | None, attempt: int) -> DataFrame:
        """b and, of the wanted replicates, n_pos, n_neg and the AUROC of each column."""
        own = np.arange(n_bootstrap) if wanted is None else wanted
        out = None
        for c in columns:
            part = F.spark_partition_id().alias("part")
            ordered = used.select("idx", "y", F.col(c).alias("v")).repartitionByRange(4 * tasks, "v").sortWithinPartitions("v")
            cells = ordered.select("*", part).mapInArrow(lambda batches, own=own, attempt=attempt: _areas(batches, seed, attempt, own), "part int, b long, pos long, neg long, area double, bad boolean")
            before = F.coalesce(F.sum("neg").over(Window.partitionBy("b").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            cells = cells.withColumn("area", F.col("area") + F.col("pos") * before)
            whole = cells.groupBy("b").agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum("area").alias("area"), F.max("bad").alias("bad"))
            a = F.try_divide(F.col("area"), F.col("n_pos").cast("double") * F.col("n_neg"))
            whole = whole.select("b", "n_pos", "n_neg", F.when(F.col("bad") & a.isNotNull(), F.lit(math.nan)).otherwise(a).alias(c))
            out = whole if out is None else out.join(whole.drop("n_pos", "n_neg"), "b")
        return out

    found = None
    for attempt in range(most_redraws + 1):
        now = sums(None if attempt == 0 else left, attempt)
        now = now.persist()
        # draws of one class: rare beyond KERNEL_ROWS rows, n_bootstrap at most
        left = np.array(sorted(r.b for r in now.where("n_pos = 0 or n_neg = 0").select("b").collect()), np.int64)
        good = now.where("n_pos > 0 and n_neg > 0").select("b", *columns)
        found = good if found is None else found.unionAll(good)
        if not len(left):
            return found
    raise ValueError(f"no draw of both classes in {most_redraws + 1} attempts")


def _areas(batches: Iterator[pa.RecordBatch], seed: int, attempt: int, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows in the order of v: pos, neg and the area within the partition for each
    b. A group of ties may go over many batches: its sums are carried along."""
    zeros = lambda: np.zeros(len(b), np.int64)
    pos, neg, area, bad, open_pos, open_neg, last, part = zeros(), zeros(), np.zeros(len(b)), np.zeros(len(b), bool), zeros(), zeros(), None, 0

    def close() -> None:
        nonlocal pos, neg, area, open_pos, open_neg
        area += open_pos * (neg + open_neg / 2)
        pos, neg, open_pos, open_neg = pos + open_pos, neg + open_neg, zeros(), zeros()

    for batch in batches:
        if not batch.num_rows:
            continue
        v, idx, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("v", "idx", "y"))
        part = batch.column("part")[0].as_py()
        same = lambda x, z: (x == z) | (np.isnan(x) & np.isnan(z))
        starts = np.flatnonzero(np.r_[True, ~same(v[1:], v[:-1])])
        if last is not None and not same(np.float64(last), v[0]):
            close()
        last = v[-1]
        p, q = np.empty((len(b), len(starts)), np.int64), np.empty((len(b), len(starts)), np.int64)
        for i in range(0, len(b), BLOCK):
            w = weights(seed, attempt, b[i : i + BLOCK], idx)
            p[i : i + BLOCK], q[i : i + BLOCK] = np.add.reduceat(w * (y == 1), starts, 1), np.add.reduceat(w * (y == 0), starts, 1)
        if np.isnan(v[-1]):
            bad |= (p + q)[:, -1] > 0
        for k in range(len(starts)):
            if k:
                close()
            open_pos, open_neg = open_pos + p[:, k], open_neg + q[:, k]
    close()
    if last is not None:
        yield pa.record_batch([pa.array(np.full(len(b), part, np.int32)), pa.array(b), pa.array(pos), pa.array(neg), pa.array(area), pa.array(bad)], ["part", "b", "pos", "neg", "area", "bad"])


def permuted_rank_sums(ranked: DataFrame, ids: DataFrame, n_pos: int, n_permutation: int, seed: int = 42, kernel_rows: int = KERNEL_ROWS) -> DataFrame:
    """ranked: sample_id, feature, r. b, feature, rank_sum: the sum of r over the
    n_pos ids of least md5 of (seed, b, id). First the n_pos-th digest of each b is
    found over the ids, which go to every task (beyond kernel_rows of them, by
    counts of the digests' next bytes, all b at once); then ranks, one shuffle of them by
    id, are multiplied with the labels in blocks, and a task hands on one row of
    n_permutation sums for each feature."""
    spark = ranked.sparkSession
    tasks = spark.sparkContext.defaultParallelism
    ids = ids.select(F.col("sample_id").cast("string").alias("id"))
    few = ids.limit(kernel_rows + 1).count() <= kernel_rows
    limit = spark.sparkContext.broadcast(_limits(ids, n_pos, n_permutation, seed) if few else _limits_by_bytes(ids, n_pos, n_permutation, seed))  # 16 bytes per b

    def products(batches):
        names: dict[str, int] = {}
        total = np.zeros((n_permutation, 0))
        for batch in _gathered(batches):
            sample, feature = (batch.column(c).dictionary_encode() for c in ("id", "feature"))
            own = Keys.of([x.encode() for x in sample.dictionary.to_pylist()])
            column = np.array([names.setdefault(f, len(names)) for f in feature.dictionary.to_pylist()], np.int64)
            if len(names) > total.shape[1]:
                total = np.concatenate([total, np.zeros((n_permutation, len(names) - total.shape[1]))], 1)
            r = np.zeros((own.n, len(names)))
            np.add.at(r, (sample.indices.to_numpy(), column[feature.indices.to_numpy()]), batch.column("r").to_numpy())
            for i in range(0, n_permutation, BLOCK):
                labels = np.array([digests(f"{seed}:{b}:", own) <= np.array(limit.value[b], "S16") for b in range(i, min(i + BLOCK, n_permutation))], float)
                total[i : i + BLOCK] += labels @ r
        if names:
            yield pa.record_batch([pa.array(list(names), pa.string()), pa.array(list(total.T), pa.list_(pa.float64()))], ["feature", "sums"])

    def added(table: pa.Table) -> pa.Table:
        sums = np.sum(np.stack(table.column("sums").to_numpy()), 0)
        return pa.table({"feature": table.column("feature").slice(0, 1), "sums": pa.array([sums], pa.list_(pa.float64()))})

    parts = ranked.select(F.col("sample_id").cast("string").alias("id"), "feature", "r").repartition(tasks, "id").sortWithinPartitions("id").mapInArrow(products, "feature string, sums array<double>")
    return parts.groupBy("feature").applyInArrow(added, "feature string, sums array<double>").select("feature", F.posexplode("sums").alias("b", "rank_sum"))


def _limits(ids: DataFrame, n_pos: int, n_permutation: int, seed: int) -> list[bytes]:
    context = ids.sparkSession.sparkContext
    known = context.broadcast([r.id.encode() for r in ids.collect()])  # at most kernel_rows

    def run(batches):
        keys = Keys.of(known.value)
        for batch in batches:
            found = [_nth(digests(f"{seed}:{b}:", keys), n_pos) for b in batch.column("b").to_pylist()]
            yield pa.record_batch([batch.column("b"), pa.array(found, pa.binary())], ["b", "limit"])

    numbers = ids.sparkSession.range(n_permutation).withColumnRenamed("id", "b").repartition(min(n_permutation, context.defaultParallelism))
    return [r.limit for r in numbers.mapInArrow(run, "b long, limit binary").orderBy("b").collect()]


def _limits_by_bytes(ids: DataFrame, n_pos: int, n_permutation: int, seed: int, n_bytes: int = 8) -> list[bytes]:
    """The same without the ids in one place: round k counts the k-th byte of the
    digests that begin like the limit. n_bytes bytes tell all digests apart."""
    limit, left = [b""] * n_permutation, [n_pos] * n_permutation
    if n_pos == 0:
        return limit
    for k in range(n_bytes):

        def run(batches, k=k, limit=limit):
            total = np.zeros((n_permutation, 256), np.int64)
            for batch in batches:
                own = Keys.of([x.encode() for x in batch.column("id").to_pylist()])
                for b in range(n_permutation):
                    first = np.frombuffer(digests(f"{seed}:{b}:", own).tobytes(), np.uint8).reshape(-1, 16)
                    like = (first[:, :k] == np.frombuffer(limit[b], np.uint8)).all(1)
                    total[b] += np.bincount(first[like, k], minlength=256)
            b, byte = np.nonzero(total)
            yield pa.record_batch([pa.array(b), pa.array(byte), pa.array(total[b, byte])], ["b", "byte", "n"])

        counts = np.zeros((n_permutation, 256), np.int64)
        for r in ids.mapInArrow(run, "b long, byte long, n long").groupBy("b", "byte").agg(F.sum("n").alias("n")).collect():  # 256 rows per b
            counts[r.b, r.byte] = r.n
        for b in range(n_permutation):
            upto = np.cumsum(counts[b])
            byte = int(np.searchsorted(upto, left[b]))
            limit[b], left[b] = limit[b] + bytes([byte]), int(left[b] - (upto[byte] - counts[b, byte]))
    return [x.ljust(16, b"\xff") for x in limit]


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """Batches of at least `rows` rows, so that many digests are made at once."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def _nth(digests: np.ndarray, n: int) -> bytes:
    """The n-th least digest; nothing is at most the empty one."""
    if n == 0:
        return b""
    return bytes(np.sort(digests)[n - 1].ljust(16, b"\0"))

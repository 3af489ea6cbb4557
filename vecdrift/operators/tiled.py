"""What points and a bank have in common, without a row of scores.

A block of points meets the patterns tile by tile, twice. The first time, running
maxima, sums and weighted sums give each point's log-sum-exp and entropy; the second
time, with these known, each tile adds its share of the divergences from the
reference. A task holds a block of points and a tile, however wide the bank is.

A bank whose packed size is within a limit is broadcast. A larger one meets the
points of (layer, part) in one sorted stream: first the part's points, some
PART_POINTS, then the layer's patterns, and these once more. Samples of more than
CHUNK positions are dealt in chunks, each with a copy of the reference.

Several temperatures share the products. Scores and probabilities themselves leave
a tile as long rows (point_cells()); nothing of a bank's width is kept."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import FLOOR
from .kernel import CELLS, KEYS, NUMBERS
from .scoring import PART_POINTS, bank_numbers

TILE, BLOCK, CHUNK = 1024, 1024, 1024
#: Of a bank that is broadcast (64 MB); streamed, it is shuffled to each part of the points, twice.
HELD_NUMBERS = 1 << 23
#: Products that several betas work on at once; one array for each stays near the core.
TOGETHER = 1 << 15
#: Products, one for each beta, and numbers of a task where the bank is broadcast.
TASK_WORK = 1 << 27
#: Rows of a task that lists cells: these cost more than the products.
TASK_CELLS = 1 << 24
SCALARS = NUMBERS[:4]


class Tile(NamedTuple):
    """Some patterns of a layer."""

    m: np.ndarray
    ids: pa.Array | None = None
    norms: pa.Array | None = None


class Block:
    """A block of points, which sees all tiles of its layer `passes` times and may hand
    on rows meanwhile. keys: the points' KEYS and _own (false in the copies of a
    reference, which hand on nothing); at: the place of each row's reference in the
    block, or -1."""

    passes = 1

    def __init__(self, keys: pa.Table, r: np.ndarray, at: np.ndarray):
        self.keys, self.r, self.at = keys, r, at

    def rows(self, own: np.ndarray, tile: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Some rows at a time, and their scores."""
        some = max(1, CELLS // len(tile))
        for i in range(0, len(own), some):
            yield own[i : i + some], self.r[own[i : i + some]] @ tile.T

    def see(self, step: int, tile: Tile) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError

    def end(self) -> Iterator[pa.RecordBatch]:
        yield from ()

    def own(self, columns: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
        """The points' rows with these columns."""
        names = [*KEYS, *columns]
        out = pa.table([*[self.keys.column(c) for c in KEYS], *columns.values()], names=names).filter(self.keys.column("_own"))
        yield from out.combine_chunks().to_batches()


class Sums:
    """The running sums of a block's points at one beta."""

    def __init__(self, n: int, beta: float):
        self.beta, self.width = beta, 0
        self.top, self.z, self.w = np.full(n, -np.inf), np.zeros(n), np.zeros(n)

    def add(self, own: np.ndarray, s: np.ndarray) -> None:
        x = s * self.beta
        top = np.maximum(self.top[own], x.max(1))
        moved, z, w = self.top[own] - top, self.z[own], self.w[own]
        x -= top[:, None]
        np.maximum(x, -800.0, out=x)  # exp is 0 from there on; 0 times it is 0
        e, kept = np.exp(x), np.exp(moved)
        self.w[own] = np.where(z > 0, kept * (w + z * moved), 0.0) + np.einsum("ij,ij->i", e, x)
        self.z[own], self.top[own] = kept * z + e.sum(1), top

    def log_p(self, own: np.ndarray, s: np.ndarray) -> np.ndarray:
        x = s * self.beta
        x -= (self.top[own] + np.log(self.z[own]))[:, None]
        return np.maximum(x, -800.0, out=x)

    @property
    def entropy(self) -> np.ndarray:
        return np.log(self.z) - self.w / self.z


class Powers:
    """exp(b * x) at several b. One that is the sum of at most FACTORS smaller ones is
    their product, so that of the nine of calibration's grid one takes an exponential."""

    FACTORS = 4

    def __init__(self, betas: np.ndarray):
        self.betas, self.steps, self.held = betas, [], np.empty(0)
        for i in np.argsort(betas, kind="stable"):
            rest, of = betas[i], []
            for j, _ in reversed(self.steps):
                while betas[j] <= rest and len(of) < self.FACTORS:
                    rest -= betas[j]
                    of.append(j)
            self.steps.append((i, [] if rest else of))

    def of(self, x: np.ndarray) -> np.ndarray:
        """One matrix for each b, until the next call."""
        n = len(self.betas) * x.size
        if len(self.held) < n:
            self.held = np.empty(n)
        out = self.held[:n].reshape(-1, *x.shape)
        for i, of in self.steps:
            if not of:
                np.exp(np.multiply(x, self.betas[i], out=out[i]), out=out[i])
            elif len(of) == 1:
                out[i] = out[of[0]]
            else:
                np.multiply(out[of[0]], out[of[1]], out=out[i])
                for j in of[2:]:
                    out[i] *= out[j]
        return out


def _below(x: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Scores less the greatest, in place; finite, so that 0 times them is 0."""
    x -= top[:, None]
    return np.maximum(x, -1e290, out=x)


class Scalars(Block):
    """The energy's terms and the entropies at each beta, from one pass. Several betas
    (inverse temperatures, so that one score is the greatest at all of them) share the
    exponentials."""

    def __init__(self, keys: pa.Table, r: np.ndarray, at: np.ndarray, betas: tuple[float, ...]):
        super().__init__(keys, r, at)
        self.sums = [Sums(len(r), b) for b in betas]
        self.together = len(betas) > 1 and min(betas) > 0
        if self.together:
            self.top, self.betas = np.full(len(r), -np.inf), np.array(betas)
            self.z, self.w = np.zeros((2, len(betas), len(r)))
            self.powers = Powers(self.betas)

    def add(self, own: slice, tile: np.ndarray) -> None:
        """Sums.add() of all betas."""
        x = self.r[own] @ tile.T
        top = np.maximum(self.top[own], x.max(1))
        moved, self.top[own] = self.betas[:, None] * (self.top[own] - top), top
        kept, z, w, one = np.exp(moved), self.z[:, own], self.w[:, own], np.ones(x.shape[1])
        w[:] = np.where(z > 0, kept * (w + z * moved), 0.0)
        z *= kept
        for e, beta, z, w in zip(self.powers.of(_below(x, top)), self.betas, z, w, strict=True):
            z += e @ one
            w += beta * np.vecdot(e, x)

    def see(self, step: int, tile: Tile) -> Iterator[pa.RecordBatch]:
        if step == 0:
            for sums in self.sums:
                sums.width += len(tile.m)
            if self.together:
                some = max(1, min(CELLS, TOGETHER) // len(tile.m))
                for i in range(0, len(self.r), some):
                    self.add(slice(i, i + some), tile.m)
                return
            for own, s in self.rows(np.arange(len(self.r)), tile.m):
                for sums in self.sums:
                    sums.add(own, s)
        else:
            self.second(tile.m)
        yield from ()

    def second(self, tile: np.ndarray) -> None:
        raise NotImplementedError

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.together:
            for sums, z, w in zip(self.sums, self.z, self.w, strict=True):
                sums.top, sums.z, sums.w = self.top * sums.beta, z, w
        for i, sums in enumerate(self.sums):
            log_z, entropy = np.log(sums.z), sums.entropy
            values = [np.full(len(self.r), sums.beta), -(sums.top + log_z) / sums.beta, np.einsum("ij,ij->i", self.r, self.r) / 2, entropy, entropy / np.log(sums.width)]
            yield from self.own(dict(zip(("beta", *SCALARS), map(pa.array, values), strict=True)) | self.more(i))

    def more(self, i: int) -> dict[str, pa.Array]:
        return {}


class Metrics(Scalars):
    """NUMBERS at each beta; the second pass adds up the divergences."""

    passes, names = 2, ("js", "hellinger_sq")

    def __init__(self, keys: pa.Table, r: np.ndarray, at: np.ndarray, betas: tuple[float, ...]):
        super().__init__(keys, r, at, betas)
        self.found = np.zeros((len(betas), len(self.names), len(r)))
        self.with_ref = np.flatnonzero(at >= 0)
        self.refs, self.place = np.unique(at[self.with_ref], return_inverse=True)
        if self.together:
            self.halves, self.parts = Powers(self.betas / 2), {}

    def part(self, own: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of rows with a reference: the references' places among those, their number,
        vectors of these and the rows, their greatest scores, and 1 / sqrt(2 z)."""
        refs, at = np.unique(self.at[own], return_inverse=True)
        both = np.r_[refs, own]
        return own, at, len(refs), self.r[both], self.top[both], np.sqrt(0.5 / self.z[:, both])[:, :, None]

    def all_shares(self, tile: np.ndarray) -> None:
        """A tile's shares of the divergences at several betas: Jensen-Shannon's as in
        shares(), and of the squared Hellinger distance what is to be taken from 1. The
        references of some rows are scored with them."""
        some = max(1, min(CELLS, TOGETHER) // len(tile))
        if some not in self.parts:  # the last tile may be narrower
            self.parts[some] = [self.part(self.with_ref[i : i + some]) for i in range(0, len(self.with_ref), some)]
        for own, at, n, r, top, scale in self.parts[some]:
            x = _below(r @ tile.T, top)
            q, shares = np.empty((len(own), len(tile))), np.empty((len(self.betas), 2, len(own)))
            for root, by, share in zip(self.halves.of(x), scale, shares, strict=True):
                np.multiply(root, by, out=x)  # the roots of p / 2 and q / 2
                p = x[n:]
                np.maximum(x[:n], FLOOR**0.5, out=x[:n])
                np.take(x[:n], at, axis=0, out=q, mode="clip")
                np.vecdot(p, q, out=share[1])
                np.multiply(q, q, out=q)
                p *= p
                q += p
                np.vecdot(q, np.log(q, out=p), out=share[0])
            shares[:, 1] *= 2
            self.found[:, :, own] -= shares

    def second(self, tile: np.ndarray) -> None:
        if self.together:
            self.all_shares(tile)
            return
        q = np.empty((len(self.refs), len(tile)))
        i = 0
        for own, s in self.rows(self.refs, tile):
            q[i : i + len(own)] = s
            i += len(own)
        for sums, found in zip(self.sums, self.found, strict=True):
            log_q = sums.log_p(self.refs, q)
            p_q = np.exp(log_q)
            i = 0
            for own, s in self.rows(self.with_ref, tile):
                at = self.place[i : i + len(own)]
                found[:, own] += self.shares(sums.log_p(own, s), log_q, p_q, at)
                i += len(own)

    def shares(self, log_p: np.ndarray, log_q: np.ndarray, q: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """A tile's shares of the divergences, by row; at: the row's reference in q."""
        p, q = np.exp(log_p, out=log_p), q[at]
        m = p + q
        m /= 2
        np.maximum(m, FLOOR, out=m)
        d = np.sqrt(p, out=p)
        d -= np.sqrt(q, out=q)
        hellinger_sq = np.einsum("ij,ij->i", d, d) / 2
        return [-np.einsum("ij,ij->i", m, np.log(m, out=q)), hellinger_sq]  # in place: new pages cost more than the sums

    def more(self, i: int) -> dict[str, pa.Array]:
        values, entropy, without = self.found[i].copy(), self.sums[i].entropy, self.at < 0
        values[0] = np.maximum(values[0] - (entropy + entropy[self.at]) / 2, 0.0)
        if self.together:
            values[1] = np.maximum(values[1] + 1, 0.0)
        return {c: pa.array(v, mask=without) for c, v in zip(self.names, values, strict=True)}


class Divergences(Metrics):
    """As well the Kullback-Leibler divergence from the reference (infinite where that
    is 0 and p is not) and the Bhattacharyya coefficient."""

    names = ("js", "kl", "bc")

    def shares(self, log_p: np.ndarray, log_q: np.ndarray, q: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        p, q = np.exp(log_p), q[at]
        m = np.maximum((p + q) / 2, FLOOR)
        kl = np.einsum("ij,ij->i", p, log_p - log_q[at])
        kl[((q == 0) & (p > 0)).any(1)] = np.inf
        return [-np.einsum("ij,ij->i", m, np.log(m)), kl, np.einsum("ij,ij->i", np.sqrt(p), np.sqrt(q))]


class Prototypes(Scalars):
    """x: the mean of the patterns, each weighing its probability."""

    passes = 2

    def __init__(self, keys: pa.Table, r: np.ndarray, at: np.ndarray, betas: tuple[float, ...]):
        super().__init__(keys, r, at, betas)
        self.x = np.zeros_like(r, float)

    def second(self, tile: np.ndarray) -> None:
        for own, s in self.rows(np.arange(len(self.r)), tile):
            self.x[own] += np.exp(self.sums[0].log_p(own, s)) @ tile

    def end(self) -> Iterator[pa.RecordBatch]:
        n, k = self.x.shape
        yield from self.own({"x": pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(self.x.ravel()))})


class Cells(Scalars):
    """A row for each point and tile: lists of pattern_id and of these columns, of
    row_norm, s, g (s * row_norm) and, with a beta, p; rounded to some places, if these
    are given. Rows leave as soon as they are found, some CELLS numbers at a time, and
    are listed outside (point_cells()), so that keys are not handed on with each cell."""

    def __init__(self, keys: pa.Table, r: np.ndarray, at: np.ndarray, betas: tuple[float, ...], columns: tuple[str, ...], places: int | None):
        super().__init__(keys, r, at, betas)
        self.passes, self.mine = len(betas) + 1, np.flatnonzero(keys.column("_own").to_numpy())
        self.columns, self.places = columns, places

    def see(self, step: int, tile: Tile) -> Iterator[pa.RecordBatch]:
        if step < len(self.sums):
            yield from super().see(step, tile)
            return
        k, norms = len(tile.m), tile.norms.to_numpy(zero_copy_only=False)
        unknown = tile.norms.is_null().to_numpy(zero_copy_only=False)
        for own, s in self.rows(self.mine, tile.m):
            ends, lists = pa.array(np.arange(len(own) + 1) * k, pa.int32()), [tile.ids.take(pa.array(np.tile(np.arange(k), len(own))))]
            for c in self.columns:
                x = s if c == "s" else s * norms if c == "g" else np.exp(self.sums[0].log_p(own, s)) if c == "p" else np.broadcast_to(norms, s.shape)
                x = x if self.places is None else rounded(x, self.places)
                lists.append(pa.array(x.ravel(), mask=np.tile(unknown, len(own)) if c in ("row_norm", "g") and unknown.any() else None))
            each = pa.array(own)
            yield pa.record_batch([*[self.keys.column(c).combine_chunks().take(each) for c in KEYS], *[pa.ListArray.from_arrays(ends, x) for x in lists]], [*KEYS, "pattern_id", *self.columns])

    def end(self) -> Iterator[pa.RecordBatch]:
        yield from ()


def rounded(x: np.ndarray, places: int) -> np.ndarray:
    """Halves go away from zero, as in SQL; without a negative zero."""
    y = x * 10.0**places
    out = np.rint(y)
    rest = y - out
    half = np.abs(rest) == 0.5
    if half.any():
        out[half] = np.trunc(y[half]) + np.sign(y[half])
    out /= 10.0**places
    out += 0.0
    return out if np.isfinite(y).all() else np.where(np.isfinite(y), out, x)


def _matrix(column: pa.Array) -> np.ndarray:
    lengths = np.unique(pc.list_value_length(column).to_numpy(zero_copy_only=False))
    if len(lengths) > 1:
        raise ValueError(f"vectors of different lengths: {lengths.tolist()}")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _changes(batch: pa.RecordBatch, names: tuple[str, ...]) -> np.ndarray:
    """Whether a row differs from the one before it in these columns; true in the
    first row."""
    new = np.zeros(len(batch), bool)
    for c in names:
        code = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    new[:1] = True
    return new


def _references(new: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Rows in runs that begin where new is: the place of each generated row's
    reference, which a run has in front, or -1."""
    start = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return np.where((position > 0) & (position[start] == 0), start, -1)


Maker = Callable[[pa.Table, np.ndarray, np.ndarray], Block]


def _blocked(make: Maker, points: pa.Table, new: np.ndarray, tiles: list[Tile]) -> Iterator[pa.RecordBatch]:
    block = make(points, _matrix(points.column("r").combine_chunks()), _references(new, points.column("position").to_numpy()))
    for step in range(block.passes):
        for tile in tiles:
            yield from block.see(step, tile)
    yield from block.end()


def dealt(points: DataFrame, longest: int) -> DataFrame:
    """KEYS, r, _chunk, and _own: false in the copies of a sample's reference that
    its chunks after the first one get."""
    rows = points.where(F.col("r").isNotNull()).select(*KEYS, F.col("r").cast("array<double>").alias("r"), F.floor(F.col("position") / CHUNK).cast("int").alias("_chunk"), F.lit(True).alias("_own"))
    if longest < CHUNK:
        return rows
    later = rows.where("_chunk > 0").select("sample_id", "layer", "_chunk").distinct()
    copies = rows.where("position = 0").drop("_chunk", "_own").join(later, ["sample_id", "layer"]).withColumn("_own", F.lit(False))
    return rows.unionByName(copies)


def point_metrics(points: DataFrame, bank: DataFrame, beta: float, way: str = "auto") -> DataFrame:
    """points: KEYS, r. bank: layer, pattern_id, m_hat. KEYS and NUMBERS of each
    point with a vector; js and hellinger_sq are null at the reference (position 0)
    and where a (sample, layer) has none. Points of a layer without patterns go;
    vectors of different lengths in a task raise. way: "array" (the bank is
    broadcast), "matrix" (it is shuffled), or by its size."""
    return metrics_by_beta(points, bank, (beta,), way).drop("beta")


def metrics_by_beta(points: DataFrame, bank: DataFrame, betas: tuple[float, ...], way: str = "auto") -> DataFrame:
    """The same at several betas, for which scores are made together: KEYS, beta,
    NUMBERS."""
    return _run(points, bank, Metrics, betas, way, _doubles("beta", *NUMBERS))


def scalars_by_beta(points: DataFrame, bank: DataFrame, betas: tuple[float, ...], way: str = "auto") -> DataFrame:
    """KEYS, beta, SCALARS: what needs no reference, from one pass."""
    return _run(points, bank, Scalars, betas, way, _doubles("beta", *SCALARS))


def point_divergences(points: DataFrame, bank: DataFrame, beta: float, way: str = "auto") -> DataFrame:
    """KEYS, beta, SCALARS, and js, kl and bc from the reference (null as in
    point_metrics())."""
    return _run(points, bank, Divergences, (beta,), way, _doubles("beta", *SCALARS, *Divergences.names))


def point_prototypes(points: DataFrame, bank: DataFrame, beta: float, way: str = "auto") -> DataFrame:
    """KEYS, x: sum_i p_i m_i."""
    return _run(points, bank, Prototypes, (beta,), way, "x array<double>")


def point_cells(points: DataFrame, bank: DataFrame, beta: float | None = None, way: str = "auto", columns: tuple[str, ...] | None = None, places: int | None = None) -> DataFrame:
    """KEYS, pattern_id and columns, row_norm, s and, with a beta, p if none are named:
    one row for each point and pattern of its layer. places: as in Cells."""
    kind = bank.schema["pattern_id"].dataType.simpleString()
    columns = columns or ("row_norm", "s", *([] if beta is None else ["p"]))
    lists = ", ".join([f"pattern_id array<{kind}>", *[f"{c} array<double>" for c in columns]])
    rows = _run(points, bank, Cells, () if beta is None else (beta,), way, lists, columns=columns, places=places)
    rows = rows.select(*KEYS, F.posexplode("pattern_id").alias("_i", "_id"), *columns)
    return rows.select(*KEYS, F.col("_id").alias("pattern_id"), *[F.col(c)[F.col("_i")].alias(c) for c in columns])


def _doubles(*names: str) -> str:
    return ", ".join(f"{c} double" for c in names)


def _run(points: DataFrame, bank: DataFrame, kind: type[Scalars], betas: tuple[float, ...], way: str, more: str, **how) -> DataFrame:
    sizes = points.groupBy("layer").agg(F.count("*").alias("n"), F.max("position").alias("longest")).collect()  # one row per layer
    rows = dealt(points, max((s["longest"] for s in sizes if s["longest"] is not None), default=0))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.select(*KEYS).schema) + ", " + more
    norm = F.col("row_norm") if "row_norm" in bank.columns else F.lit(None)
    bank = bank.select("layer", "pattern_id", norm.cast("double").alias("row_norm"), F.col("m_hat").cast("array<double>").alias("m_hat"))
    betas = tuple(map(float, betas))

    def make(keys: pa.Table, r: np.ndarray, at: np.ndarray) -> Block:
        return kind(keys, r, at, betas, **how)

    if way == "auto":
        way = "array" if bank_numbers(bank) <= HELD_NUMBERS else "matrix"
    if way == "array":
        return _with_broadcast(rows, bank, make, schema, {s["layer"]: s["n"] * max(1, len(betas)) for s in sizes}, TASK_CELLS if kind is Cells else TASK_WORK)
    passes = len(betas) + 1 if kind is Cells else kind.passes
    return _with_stream(rows, bank, make, passes, schema, {s["layer"]: -(-s["n"] // PART_POINTS) for s in sizes})


def _with_broadcast(rows: DataFrame, bank: DataFrame, make: Maker, schema: str, uses: dict, work: int) -> DataFrame:
    """uses: how often a layer's patterns are used, its points times betas; work: of a
    task. Tasks are dealt by it: by bytes, a few small partitions would hold all of it."""
    held: dict = {}
    table = bank.toArrow()  # of a checked size
    for layer in table.column("layer").unique().to_pylist():
        own = table.filter(pc.equal(table.column("layer"), layer)).combine_chunks()
        if len(own):
            held[layer] = _tiles(own.to_batches()[0])
    known = rows.sparkSession.sparkContext.broadcast(held)
    tasks = 1 + sum(uses.get(layer, 0) * (sum(len(t.m) for t in tiles) + tiles[0].m.shape[1]) for layer, tiles in held.items()) // work
    run_of = ("layer", "sample_id", "_chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reference = None  # of the run that a block may continue: one row of the table
        for batch in batches:
            table, new, layers = pa.Table.from_batches([batch]), _changes(batch, run_of), np.flatnonzero(_changes(batch, ("layer",)))
            for a, b in zip(layers, [*layers[1:], len(batch)], strict=True):
                layer = batch.column("layer")[a].as_py()
                tiles = known.value.get(layer)
                for start in range(a, b, BLOCK):
                    part, first = table.slice(start, min(BLOCK, b - start)), new[start : min(b, start + BLOCK)].copy()
                    if reference is not None and all(reference.column(c)[0] == part.column(c)[0] for c in run_of):
                        part, first = pa.concat_tables([reference, part]), np.r_[True, False, first[1:]]
                    else:
                        first[0] = True
                    last = int(np.flatnonzero(first)[-1])
                    head, own_at = part.slice(last, 1), part.schema.get_field_index("_own")
                    reference = head.set_column(own_at, head.schema.field(own_at), pa.array([False])) if head.column("position")[0].as_py() == 0 else None
                    if tiles is not None:
                        yield from _blocked(make, part, first, tiles)

    together = rows.repartition(tasks, "sample_id", "layer", "_chunk").sortWithinPartitions(*run_of, "position")
    return together.mapInArrow(_quiet(run), schema)


def _tiles(patterns: pa.RecordBatch, column: str = "m_hat") -> list[Tile]:
    cut = [patterns.slice(i, TILE) for i in range(0, len(patterns), TILE)]
    return [Tile(_matrix(t.column(column)), *[t.column(c).take(pa.array(np.arange(len(t)))) for c in ("pattern_id", "row_norm")]) for t in cut]  # a slice would be broadcast with all that it was cut from


def _quiet(run: Callable) -> Callable:
    def quiet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(invalid="ignore", divide="ignore"):
            yield from run(batches)

    return quiet


def _with_stream(rows: DataFrame, bank: DataFrame, make: Maker, passes: int, schema: str, parts: dict) -> DataFrame:
    """_step: 0 for points, then the number of the pass."""
    spark, kind = rows.sparkSession, rows.schema["layer"].dataType.simpleString()
    counts = F.broadcast(spark.createDataFrame(list(parts.items()), f"layer {kind}, _parts int"))  # one row per layer
    names = ("layer", "_part", "_step", *KEYS[::2], "_chunk", "_own", "r", "pattern_id", "row_norm")
    part = F.pmod(F.xxhash64("sample_id", "_chunk"), F.col("_parts")).cast("int")
    none = [F.lit(None).cast(bank.schema[c].dataType).alias(c) for c in ("pattern_id", "row_norm")]
    left = rows.join(counts, "layer").withColumn("_part", part).withColumn("_step", F.lit(0)).select(*names[:-2], *none)
    blank = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("sample_id", "position", "_chunk", "_own")]
    right = bank.join(counts, "layer").select(F.col("layer").cast(kind).alias("layer"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), F.col("m_hat").alias("r"), "pattern_id", "row_norm", *blank)
    right = right.withColumn("_step", F.explode(F.array(*[F.lit(i + 1) for i in range(passes)]))).select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, block = None, [], None
        for batch in batches:
            starts = np.flatnonzero(_changes(batch, ("layer", "_part", "_step")))
            for a, b in zip(starts, [*starts[1:], len(batch)], strict=True):
                some = batch.slice(a, b - a)
                now, step = (some.column("layer")[0].as_py(), some.column("_part")[0].as_py()), some.column("_step")[0].as_py()
                if now != key:
                    if block is not None:
                        yield from block.end()
                    key, held, block = now, [], None
                if step == 0:
                    held.append(some)
                    continue
                if held:
                    points = pa.Table.from_batches(held).combine_chunks()
                    new = _changes(points.to_batches()[0], ("sample_id", "_chunk"))
                    block = make(points.select([*KEYS, "_own"]), _matrix(points.column("r").combine_chunks()), _references(new, points.column("position").to_numpy()))
                    points, held = None, []
                if block is not None:
                    for tile in _tiles(some, "r"):
                        yield from block.see(step - 1, tile)
        if block is not None:
            yield from block.end()

    tasks = 2 * sum(parts.values()) + 1  # given: by bytes, parts would be put together, and few tasks have all the work
    together = left.unionByName(right).repartition(tasks, "layer", "_part").sortWithinPartitions("layer", "_part", "_step", "sample_id", "_chunk", "position")
    return together.mapInArrow(_quiet(run), schema)

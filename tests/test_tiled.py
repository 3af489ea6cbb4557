"""Metrics by tiles against the kernel that sees whole rows of scores."""

import numpy as np
import pytest

from vecdrift.operators import bank, kernel, scoring, tiled, trajectory


@pytest.fixture(scope="module")
def odd(spark):
    """Points of two layers: NaN, no reference, no vector, a lone reference, a sample
    longer than a chunk; and a bank of more than one tile."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(12):
        for layer in range(2):
            for t in range(1 if i == 3 else 0, 1 if i == 4 else 30 if i == 5 else 4):
                r = (rng.normal(size=5) * (30 if i == 6 else 1)).tolist()
                if i == 7 and t == 2:
                    r[0] = float("nan")
                rows.append((f"s{i}", layer, t, None if i == 8 and t == 1 else r))
    rng.shuffle(rows)
    points = spark.createDataFrame([tuple(x) for x in rows], "sample_id string, layer int, position int, r array<double>").repartition(3)
    weights = [(layer, k, rng.normal(size=5).tolist()) for layer in range(2) for k in range(70)]
    return points, bank.build_bank(spark.createDataFrame(weights, "layer int, pattern_id long, weights array<double>"))


@pytest.mark.parametrize("way", ["array", "matrix"])
@pytest.mark.parametrize("beta", [1.0, 40.0])
def test_tiles_give_what_whole_rows_give(odd, way, beta, monkeypatch):
    for name, value in (("TILE", 16), ("BLOCK", 7), ("CHUNK", 8), ("PART_POINTS", 20), ("CELLS", 64)):
        monkeypatch.setattr(tiled, name, value)
    points, b = odd
    got = tiled.point_metrics(points, b, beta, way).collect()
    want = {(r.sample_id, r.layer, r.position): r for r in trajectory.metrics_of_scores(scoring.score(points.where("r is not null"), b, "array"), beta).collect()}
    assert len(got) == len(want) == len({(r.sample_id, r.layer, r.position) for r in got})
    for r in got:
        for n in kernel.NUMBERS:
            x, y = r[n], want[r.sample_id, r.layer, r.position][n]
            assert (x is None) == (y is None), (r, n)
            assert x is None or x == pytest.approx(y, abs=1e-12, rel=1e-9, nan_ok=True), (r, n)


def test_tasks_follow_the_work(odd, monkeypatch):
    """points times patterns times betas, not bytes, deal the tasks."""
    points, b = odd
    monkeypatch.setattr(tiled, "TASK_WORK", 2500)
    n = points.count()
    want = tiled.metrics_by_beta(points, b, (1.0, 5.0), "matrix").collect()
    for betas in ((1.0,), (1.0, 5.0)):
        made = tiled.metrics_by_beta(points, b, betas, "array")
        assert made.rdd.getNumPartitions() == 1 + n * len(betas) * (70 + 5) // 2500
    key = lambda r: (r.sample_id, r.layer, r.position, r.beta)
    got = {key(r): r for r in made.collect()}
    assert set(got) == {key(r) for r in want} and len(got) == len(want)
    for r in want:
        assert all(got[key(r)][c] == (None if r[c] is None else pytest.approx(r[c], abs=1e-12, rel=1e-9, nan_ok=True)) for c in kernel.NUMBERS)


def test_shares_make_few_new_arrays():
    """a block's divergences are made in place, and are the same."""
    import tracemalloc

    rng = np.random.default_rng(3)
    p, q = (np.log(rng.dirichlet(np.ones(2048), n)) for n in (40, 8))
    at = np.repeat(np.arange(8), 5)
    m = (np.exp(p) + np.exp(q)[at]) / 2
    want = [-(m * np.log(m)).sum(1), ((np.sqrt(np.exp(p)) - np.sqrt(np.exp(q)[at])) ** 2).sum(1) / 2]
    given, probabilities = p.copy(), np.exp(q)
    tracemalloc.start()
    got = tiled.Metrics.shares(None, given, q, probabilities, at)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * p.nbytes  # 5 when each step had its own
    assert all(a == pytest.approx(b, abs=1e-12) for a, b in zip(got, want, strict=True))
    assert (probabilities == np.exp(q)).all()


def test_no_column_of_scores_and_no_rows(odd, spark):
    points, b = odd
    for way in ("array", "matrix"):
        made = tiled.point_metrics(points, b, 2.0, way)
        plan = made._jdf.queryExecution().toString()
        assert "scores" not in plan
        none = tiled.point_metrics(points.limit(0), b, 2.0, way)
        assert none.columns == [*kernel.KEYS, *kernel.NUMBERS] and none.count() == 0


def test_vectors_of_different_lengths_raise(odd, spark):
    points = spark.createDataFrame([("a", 0, 0, [1.0] * 5), ("a", 0, 1, [1.0] * 4)], odd[0].schema).coalesce(1)
    for way in ("array", "matrix"):
        with pytest.raises(Exception, match="different lengths"):
            tiled.point_metrics(points, odd[1], 2.0, way).collect()


@pytest.mark.parametrize("way", ["array", "matrix"])
def test_every_kind_gives_what_whole_rows_give(odd, way, monkeypatch):
    from pyspark.sql import functions as F
    from vecdrift.functions import metrics as M

    for name, value in (("TILE", 16), ("BLOCK", 7), ("CHUNK", 8), ("PART_POINTS", 20), ("CELLS", 64)):
        monkeypatch.setattr(tiled, name, value)
    points, b = odd
    whole = scoring.score(points.where("r is not null and sample_id <> 's7'"), b, "array")
    points = points.where("sample_id <> 's7'")
    key = lambda r: (r.sample_id, r.layer, r.position)
    p = whole.withColumn("p", M.softmax("scores", 3.0))
    ids = bank.pack(b).select("layer", "pattern_ids", F.col("m_hat").alias("m"))
    want = {key(r): r for r in p.join(ids, "layer").withColumn("x", M.retrieved_prototype("p", "m")).collect()}
    cells = {(key(r), r.pattern_id): r for r in tiled.point_cells(points, b, 3.0, way).collect()}
    assert len(cells) == 70 * len(want)
    for k, r in want.items():
        for i, s, q in zip(r.pattern_ids, r.scores, r.p, strict=True):
            assert (cells[k, i].s, cells[k, i].p) == (pytest.approx(s, abs=1e-9), pytest.approx(q, abs=1e-12))
    norms = {(r.layer, r.pattern_id): r.row_norm for r in b.collect()}
    assert all(r.row_norm == norms[k[0][1], k[1]] for k, r in cells.items())
    got = tiled.point_prototypes(points, b, 3.0, way).collect()
    assert len(got) == len(want)
    assert all(r.x == pytest.approx(want[key(r)].x, abs=1e-9) for r in got)
    ref = p.where("position = 0").select("sample_id", "layer", F.col("p").alias("q"))
    pairs = p.where("position > 0").join(ref, ["sample_id", "layer"]).select(*kernel.KEYS, M.kl_nats("p", "q").alias("kl"), M.bhattacharyya("p", "q").alias("bc"), M.js_by_entropy("p", "q").alias("js"))
    pairs, got = {key(r): r for r in pairs.collect()}, {key(r): r for r in tiled.point_divergences(points, b, 3.0, way).collect()}
    assert {k for k, r in got.items() if r.js is not None} == set(pairs)
    for k, r in pairs.items():
        assert (got[k].kl, got[k].bc, got[k].js) == tuple(pytest.approx(v, abs=1e-9, rel=1e-9) for v in (r.kl, r.bc, r.js)), k
    one = {b_: {key(r): r for r in tiled.point_metrics(points, b, b_, way).collect()} for b_ in (1.0, 5.0)}
    for r in tiled.metrics_by_beta(points, b, (1.0, 5.0), way).collect() + tiled.scalars_by_beta(points, b, (1.0, 5.0), way).collect():
        for n in set(kernel.NUMBERS) & set(r.asDict()):
            assert r[n] == pytest.approx(one[r.beta][key(r)][n], abs=1e-12, nan_ok=True) if r[n] is not None else one[r.beta][key(r)][n] is None


def test_queries_on_scores_hold_no_row_of_scores(spark, small):
    """F1 to F16: none has a column of a bank's width."""
    from vecdrift.plans import registry

    for name in "retrieval_scores retrieval_scores_matrix raw_preactivation retrieval_distribution lse_quadratic_energy kl_bhattacharyya retrieved_prototype calibration_curve beta_star_clamped entropy_beta_sweep features_at_beta full_beta_sweep beta_class_means".split():
        assert "scores" not in registry.QUERIES[name](spark, small)._jdf.queryExecution().toString(), name


def test_parts_of_scores_are_bounded(odd, monkeypatch):
    points, b = odd
    points = points.where("r is not null and sample_id <> 's7'")
    want = {(r.sample_id, r.layer, r.position): r.scores for r in scoring.score(points, b, "array").collect()}
    monkeypatch.setattr(scoring, "PART_CELLS", 140)
    sizes = []
    product = scoring._score_matrix(points, b)
    for r in product.collect():
        assert r.scores == pytest.approx(want[r.sample_id, r.layer, r.position], abs=1e-12)
        sizes.append(len(r.scores))
    assert len(sizes) == len(want)


def test_cells_are_rounded_and_dealt_in_tasks(odd, monkeypatch):
    """Tasks follow the number of rows, which come rounded, as SQL rounds."""
    import duckdb

    x = np.r_[0.0, -1e-9, 5e-7, -5e-7, 1.5e-6, 2.5e-6, 0.49999999999999994e-6, 1e300, -1e303, np.nan, np.inf, np.random.default_rng(2).normal(size=500)]
    want = duckdb.connect().execute("SELECT round(unnest(?::DOUBLE[]), 6) + 0.0::DOUBLE", [x.tolist()]).fetchall()
    got = tiled.rounded(x, 6)
    assert np.array_equal(got, [r[0] for r in want], equal_nan=True) and not np.signbit(got[:2]).any()
    monkeypatch.setattr(tiled, "TASK_CELLS", 500)
    points, b = odd
    made = tiled.point_cells(points, b, 3.0, "array", ("p", "g"), 6)
    assert made.columns == [*kernel.KEYS, "pattern_id", "p", "g"] and "round(" not in made._jdf.queryExecution().toString()
    assert made.rdd.getNumPartitions() == 1 + points.count() * (70 + 5) // 500
    key = lambda r: (r.sample_id, r.layer, r.position, r.pattern_id)
    whole = {key(r): r for r in tiled.point_cells(points, b, 3.0, "matrix").collect()}
    rows = made.collect()
    assert {key(r) for r in rows} == set(whole) and len(rows) == len(whole)
    for r in rows:
        w = whole[key(r)]
        assert (r.p, r.g) == tuple(pytest.approx(v, abs=5.001e-7, nan_ok=True) for v in (w.p, w.s * w.row_norm))


def test_betas_share_exponentials(monkeypatch):
    """a pass takes one exponential of a score for all nine temperatures."""
    import pyarrow as pa
    from vecdrift.operators.calibration import BETA_GRID

    rng = np.random.default_rng(5)
    n, k, betas = 60, 2500, tuple(map(float, BETA_GRID))
    r, m, position = rng.normal(size=(n, 6)), rng.normal(size=(k, 6)), np.arange(n) % 6
    keys = pa.table({"sample_id": np.arange(n) // 6, "layer": np.zeros(n, np.int32), "position": position, "_own": np.ones(n, bool)})
    block = tiled.Metrics(keys, r, np.where(position > 0, np.arange(n) - position, -1), betas)
    made, exp = [], np.exp
    monkeypatch.setattr(np, "exp", lambda x, **how: made.append(np.size(x)) or exp(x, **how))
    for step in range(block.passes):
        for i in range(0, k, tiled.TILE):
            list(block.see(step, tiled.Tile(m[i : i + tiled.TILE])))
    monkeypatch.undo()
    assert sum(made) < 2.5 * n * k  # 18 when each had its own; references are scored again
    got = {(x["sample_id"], x["position"], x["beta"]): x for b in block.end() for x in b.to_pylist()}
    assert len(got) == n * len(betas)
    for beta in betas:
        p, h, lse = kernel.distributions(r @ m.T, beta)
        for i in range(n):
            x, ref = got[i // 6, position[i], beta], i - position[i]
            assert (x["entropy"], x["lse_term"]) == (pytest.approx(h[i], abs=1e-11), pytest.approx(lse[i], abs=1e-11))
            if position[i]:
                js, hellinger_sq = kernel.divergences(p[i : i + 1], p[ref : ref + 1], h[i : i + 1], h[ref])
                assert (x["js"], x["hellinger_sq"]) == (pytest.approx(js[0], abs=1e-11), pytest.approx(hellinger_sq[0], abs=1e-11))
            else:
                assert x["js"] is None and x["hellinger_sq"] is None


def test_a_tile_is_broadcast_without_its_layer():
    """a pickled tile has its own ids and norms, not all of its layer's."""
    import pickle

    import pyarrow as pa

    k = 8 * tiled.TILE
    layer = pa.record_batch([pa.array(np.arange(k)), pa.array(np.ones(k)), pa.array([[1.0]] * k)], ["pattern_id", "row_norm", "m_hat"])
    tiles = tiled._tiles(layer)
    assert [t.ids[0].as_py() for t in tiles] == list(range(0, k, tiled.TILE))
    assert len(pickle.dumps(tiles)) < 1.5 * k * 24  # 11 times when each held the layer's

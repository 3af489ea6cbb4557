import collections
import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vecdrift.functions import metrics as M
from vecdrift.functions.metrics import keyed_order
from vecdrift.operators import bank, calibration, features, kernel, labels, probe, scoring, selection, sensitivity, splits, stats, trajectory
from vecdrift.sources import readers, writers
from vecdrift.streaming import incremental


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(0)
    points = [(f"s_{i}", layer, t, rng.normal(size=6).tolist()) for i in range(6) for layer in range(2) for t in range(4)]
    weights = [(layer, k, rng.normal(size=6).tolist()) for layer in range(2) for k in range(9)]
    return spark.createDataFrame(points, "sample_id string, layer int, position int, r array<double>").cache(), spark.createDataFrame(weights, "layer int, pattern_id long, weights array<double>").cache()


def test_bank_rejections_and_transpose(world):
    for bad in ("down", "down_proj", "nothing"):
        with pytest.raises(ValueError):
            bank.resolve_projection(bad)
    b = bank.build_bank(world[1], "w2")
    assert b.count() == 12 and b.select(F.size("m_hat")).first()[0] == 9
    assert {(r["n_patterns"], r["dim"]) for r in bank.bank_dims(bank.build_bank(world[1])).collect()} == {(9, 6)}


def test_both_ways_score_alike(world):
    b = bank.build_bank(world[1])
    a = {(r.sample_id, r.layer, r.position): r.scores for r in scoring.score(world[0], b, "array").collect()}
    m = {(r.sample_id, r.layer, r.position): r.scores for r in scoring.score(world[0], b, "matrix").collect()}
    assert a.keys() == m.keys()
    assert all(np.allclose(a[k], m[k], atol=1e-9) for k in a)


def test_failures_are_isolated(spark, world):
    p = world[0].where("sample_id <> 's_1' or position = 0").withColumn("r", F.when((F.col("sample_id") == "s_2") & (F.col("position") == 1), F.array(F.lit(float("nan")))).otherwise(F.col("r")))
    rows, failures, report = trajectory.run_trajectories(p, bank.build_bank(world[1]), 5.0, 6)
    assert {r.sample_id: r.error for r in failures.collect()} == {"s_1": "zero generated tokens", "s_2": "wrong length"}
    assert report.first().asDict() == {"n_done": 4, "n_failed": 2, "n_skipped": 0}
    assert rows.where("sample_id = 's_1' and isnan(entropy)").count() == 4
    with pytest.raises(ValueError):
        bank.check_layers(p.where("layer = 0"), bank.build_bank(world[1]))


def test_features_and_recompute(world):
    b = bank.build_bank(world[1])
    online = features.feature_long(trajectory.trajectories(world[0], b, 4.0))
    again = sensitivity.features_at_beta(trajectory.score_cache(world[0], b).withColumn("scores", F.col("scores").cast("array<double>")), 4.0)
    a = {(r.sample_id, r.layer): r for r in online.collect()}
    for r in again.collect():
        assert r.mean_js == pytest.approx(a[r.sample_id, r.layer].mean_js, rel=1e-3, abs=1e-6)
    wide = features.pivot_features(online, 2)
    assert features.infer_n_layers(wide) == 2
    assert features.feature_columns(2)[:3] == ["delta_energy_l0", "delta_energy_l1", "delta_norm_entropy_l0"]
    with pytest.raises(ValueError):
        features.infer_n_layers(world[0])
    full = sensitivity.full_sweep(trajectory.score_cache(world[0], b), (4.0, 8.0)).where("beta = 4.0").collect()
    one = {(r.sample_id, r.layer): r for r in sensitivity.features_at_beta(trajectory.score_cache(world[0], b), 4.0).collect()}
    assert len(full) == 12
    for r in full:
        assert all(r[f] == pytest.approx(one[r.sample_id, r.layer][f]) for f in features.GROUPS)


def test_kernel_equals_the_column_functions(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(40):  # rows of different lengths, NaN, no reference, no order, and more cells than a block
        k = (3, 5, 9000)[i % 3]
        for t in range(1 if i == 7 else 0, 4):
            s = rng.normal(size=k) * (40 if i % 5 == 0 else 1)
            if i == 4 and t == 2:
                s[0] = np.nan
            rows.append((f"s{i % 20}", i // 20, t, s.tolist(), 0.5))
    rng.shuffle(rows)
    df = spark.createDataFrame([(a, b, c, d, e) for a, b, c, d, e in rows], "sample_id string, layer int, position int, scores array<double>, quadratic_term double").repartition(3).cache()
    betas = (1.0, 20.0)
    got = {(r.sample_id, r.layer, r.position, r.beta): r for r in kernel.metric_rows(df, betas).collect()}
    h = {(r.sample_id, r.layer, r.position, r.beta): r.h for r in kernel.norm_entropies(df, betas, ("sample_id", "layer", "position")).collect()}
    assert len(got) == len(h) == 2 * len(rows)
    ref = df.where("position = 0").select("sample_id", "layer", F.col("scores").alias("q"))
    for b in betas:
        both = df.join(ref, ["sample_id", "layer"], "left").withColumn("p", M.softmax("scores", b)).withColumn("r", M.softmax("q", b))
        want = both.select(
            "sample_id", "layer", "position", "quadratic_term", M.lse_term("scores", b).alias("lse_term"), M.entropy("p").alias("entropy"), M.norm_entropy("p").alias("norm_entropy"),
            F.when((F.col("position") > 0) & F.col("q").isNotNull(), M.js_nats("p", "r")).alias("js"), F.when((F.col("position") > 0) & F.col("q").isNotNull(), M.hellinger_sq("p", "r")).alias("hellinger_sq"),
        )
        for w in want.collect():
            key = (w.sample_id, w.layer, w.position, b)
            for name in kernel.NUMBERS:
                x, y = got[key][name], w[name]
                assert (x is None) == (y is None), (key, name)
                assert x is None or x == pytest.approx(y, abs=1e-12, rel=1e-9, nan_ok=True), (key, name)
            assert h[key] == pytest.approx(w.norm_entropy, abs=1e-12, nan_ok=True)


def test_no_scores_are_exchanged(world):
    b = bank.build_bank(world[1])
    for way in ("array", "matrix"):
        plan = trajectory.trajectories(world[0], b, 4.0, way)._jdf.queryExecution().optimizedPlan().toString()
        above = plan[: plan.index("MapInArrow")]
        assert "Join" not in above and "Repartition" not in above
        got = {(r.sample_id, r.layer, r.position): r for r in trajectory.trajectories(world[0], b, 4.0, way).collect()}
        want = {(r.sample_id, r.layer, r.position): r for r in trajectory.metrics_of_scores(scoring.score(world[0], b, "array"), 4.0).collect()}
        assert got.keys() == want.keys()
        assert all(got[k][n] == pytest.approx(want[k][n]) for k in got for n in kernel.NUMBERS)


def test_beta_interpolation(spark):
    curve = lambda h: spark.createDataFrame(list(zip(calibration.BETA_GRID, h)), "beta double, mean_norm_entropy double")
    line = [1 - 0.2 * math.log(b) for b in calibration.BETA_GRID]
    r = calibration.interpolate_beta(curve(line)).first()
    assert r.beta_star == pytest.approx(math.exp(0.45 / 0.2)) and not r.clamped
    assert calibration.interpolate_beta(curve(np.linspace(0.5, 0.1, 9).tolist())).first().asDict() == {"beta_star": 1.0, "clamped": True}
    assert calibration.interpolate_beta(curve(np.linspace(0.9, 0.6, 9).tolist())).first().asDict() == {"beta_star": 100.0, "clamped": True}
    with pytest.raises(ValueError):
        calibration.require_beta(None)


def _pairwise(y, s):
    p, n = [b for a, b in zip(y, s) if a], [b for a, b in zip(y, s) if not a]
    return sum((a > b) + 0.5 * (a == b) for a in p for b in n) / (len(p) * len(n))


def test_auroc_with_ties(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 200).tolist()
    s = np.round(np.array(y) + rng.normal(size=200), 1).tolist()
    df = spark.createDataFrame(list(zip(y, s)), "y int, score double")
    assert stats.auroc(df).first().auroc == pytest.approx(_pairwise(y, s))
    assert stats.auroc_by(df.withColumn("g", F.lit(1)), ["g"]).first().auroc == pytest.approx(_pairwise(y, s))
    assert stats.auroc(df.where("y = 1")).first().auroc is None
    assert stats.auroc(df.limit(0)).first().n_pos == 0
    nan = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, 0.8), (0, float("nan"))], "y int, score double")
    assert math.isnan(stats.auroc(nan).first().auroc) and math.isnan(stats.auroc_by(nan.withColumn("g", F.lit(1)), ["g"]).first().auroc)
    assert stats.auroc(nan.where("y = 0")).first().auroc is None


def test_bootstrap_redraws_single_class_draws(spark):
    rows = spark.createDataFrame([(i, int(i == 0), float(i == 0)) for i in range(31)], "idx long, y int, score double")
    ci = stats.bootstrap_auroc_ci(rows, 60)
    assert {r.n_draws for r in ci.collect()} == {60} and all(r.above for r in ci.collect())
    assert stats.bonferroni(ci).first().significant
    for one in (rows.where("y = 0"), rows.limit(0)):
        with pytest.raises(ValueError):
            stats.bootstrap_auroc_ci(one, 5)
    rare = spark.createDataFrame([(i, int(i == 0)) for i in range(4)], "idx long, y int")
    drawn = stats.draws(rare, 200).groupBy("b").agg(F.count("*").alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi")).collect()
    assert len(drawn) == 200 and {(r.n, r.lo, r.hi) for r in drawn} == {(4, 0, 1)}


def test_draws_equal_a_plain_loop(spark):
    rows = spark.createDataFrame([(i, i % 2) for i in range(7)], "idx long, y int")
    got = collections.defaultdict(list)
    for r in stats.draws(rows, 5).collect():
        got[r.b].append(r.idx)
    for b in range(5):
        for a in range(1000):
            own = [int(hashlib.md5(f"42:{b}:{a}:{j}".encode()).hexdigest()[:15], 16) % 7 for j in range(7)]
            if len({i % 2 for i in own}) == 2:
                break
        assert sorted(got[b]) == sorted(own)


def test_scan_finds_a_planted_column(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 120)
    x = rng.normal(size=(120, 4))
    x[:, 2] -= 3 * y
    rows = [(i, f"f_l{j}", float(x[i, j]) if i % 9 or j != 3 else float("nan"), int(y[i])) for i in range(120) for j in range(4)]
    got = {r.feature: r for r in stats.permutation_scan(spark.createDataFrame(rows, "sample_id long, feature string, value double, y int"), 50).collect()}
    assert got["f_l2"].significant and not got["f_l0"].significant and got["f_l0"].n_significant == 1


def test_split_sizes_lock_and_folds(spark, tmp_path):
    rows = spark.createDataFrame([(f"s{i:04d}", i % 3 == 0) for i in range(101)], "sample_id string, y boolean").withColumn("y", F.col("y").cast("int"))
    forced = rows.where("sample_id < 's0010'").select("sample_id")
    path = f"file://{tmp_path}/split"
    split = splits.locked_split(rows, path, forced=forced)
    n = {r.split: r["count"] for r in split.groupBy("split").count().collect()}
    assert n == {"test": 15, "val": 15, "train": 71}
    assert split.where("forced and split <> 'train'").count() == 0
    assert splits.locked_split(rows, path, seed=7).exceptAll(split).count() == 0
    with pytest.raises(ValueError):
        splits.check_locked(split.limit(50), "0")
    with pytest.raises(ValueError):
        splits.stratified_split(rows, ratios=(0.5, 0.1, 0.1))
    assert splits.kfold(rows, 4).groupBy("y", "fold").count().count() == 8


def test_places_in_a_giant_class_are_those_of_one_window(spark):
    rows = spark.range(30_000).select(F.col("id").alias("sample_id"), (F.col("id") == 5).cast("int").alias("y"))
    one = F.row_number().over(Window.partitionBy("y").orderBy(keyed_order(42, "sample_id"), "sample_id"))
    assert splits.place_in_class(rows, 42).withColumn("q", one).where("_p <> q").count() == 0
    plan = splits.place_in_class(rows, 42)._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(y" in plan and ", _b" in plan.split("windowspecdefinition(y", 1)[1][:60]


def test_probe_matches_newton_and_leaks_nothing(spark):
    rng = np.random.default_rng(3)
    n = 90
    x = rng.normal(size=(n, 2))
    y = (x[:, 0] + rng.normal(size=n) > 0).astype(int)
    rows = spark.createDataFrame([(f"s{i:03d}", float(i), float(x[i, 0]), float("nan") if i % 7 == 0 else float(x[i, 1]), int(y[i])) for i in range(n)], "sample_id string, place double, a double, b double, y int")
    split = splits.stratified_split(rows.select("sample_id", "y")).select("sample_id", "split")
    rows = rows.join(split, "sample_id")
    test_ids = {r.place for r in rows.where("split = 'test'").collect()}
    seen = []
    got = probe.run_protocol(rows, ["a", "b"], (0.1, 1.0), 2, 2, fitted=lambda d: seen.append({r.place for r in d.select("place").collect()}))
    assert len(seen) == got["n_fits"] == 2 * 2 + 2 + 1
    assert not any(s & test_ids for s in seen)
    assert got["test_auroc"] > 0.5

    assert got == _plain_protocol(rows.collect(), ["a", "b"], splits.kfold(rows.where("split = 'train'"), 2, 42, "f").collect(), splits.kfold(rows.where("split <> 'test'"), 2, 42, "f").collect(), (0.1, 1.0), 2) | {"test": got["test"]}
    fit = probe.Probe(["a", "b"], 0.5).fit(rows)
    w, scale = _plain_fit(rows.collect(), ["a", "b"], 0.5)
    assert np.allclose(fit.weights[0], w, atol=1e-6)
    scores = {r.sample_id: r.score for r in fit.scores(rows.withColumn("y", F.when(F.col("place") > 5, F.col("y")))).collect()}
    assert len(scores) == n and all(scores[r.sample_id] == pytest.approx(1 / (1 + math.exp(-(scale([r]) @ w)[0]))) for r in rows.collect())


def _plain_fit(rows, columns, c):
    """Newton's method on all rows at once."""
    x, y = np.array([[r[k] for k in columns] for r in rows], float), np.array([r.y for r in rows])
    medians = np.nanmedian(x, 0)
    filled = np.where(np.isnan(x), medians, x)
    mean, std = filled.mean(0), filled.std(0)
    scale = lambda own: np.c_[(np.where(np.isnan(v := np.array([[r[k] for k in columns] for r in own], float)), medians, v) - mean) / std, np.ones(len(own))]
    z, w, penalty = scale(rows), np.zeros(len(columns) + 1), np.r_[np.full(len(columns), 1 / c), 0]
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w = w - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (p - y) + penalty * w)
    return w, scale


def _plain_auroc(fit_rows, held, columns, c):
    w, scale = _plain_fit(fit_rows, columns, c)
    return _pairwise([r.y for r in held], (scale(held) @ w).tolist())


def _plain_protocol(rows, columns, inner, outer, grid, k):
    ki, ko = k if isinstance(k, tuple) else (k, k)
    means = {c: np.mean([_plain_auroc([r for r in inner if r.f != i], [r for r in inner if r.f == i], columns, c) for i in range(ki)]) for c in grid}
    best = max(grid, key=lambda c: (means[c], -grid.index(c)))
    folds = [_plain_auroc([r for r in outer if r.f != i], [r for r in outer if r.f == i], columns, best) for i in range(ko)]
    test = _plain_auroc([r for r in rows if r.split != "test"], [r for r in rows if r.split == "test"], columns, best)
    about = lambda x: pytest.approx(float(x), abs=1e-9)
    return {"best_c": best, "inner": {c: about(m) for c, m in means.items()}, "outer_mean": about(np.mean(folds)), "outer_std": about(np.std(folds)), "test_auroc": about(test), "n_fits": len(grid) * ki + ko + 1}


def test_probe_sweeps(spark, world):
    b = bank.build_bank(world[1])
    rng = np.random.default_rng(8)
    many = [(f"m_{i}", layer, t, (rng.normal(size=6) + (i % 2) * t).tolist()) for i in range(40) for layer in range(2) for t in range(3)]
    cache = trajectory.score_cache(spark.createDataFrame(many, world[0].schema), b).cache()
    truth = spark.createDataFrame([(f"m_{i}", i % 2) for i in range(40)], "sample_id string, y int")
    samples = truth.join(splits.stratified_split(truth).select("sample_id", "split"), "sample_id")
    full = {r.beta: r.probe_auroc for r in sensitivity.full_probe_sweep(sensitivity.full_sweep(cache, (1.0, 5.0)), samples, 2, (1.0, 5.0)).collect()}
    for beta, a in full.items():
        wide = samples.join(features.pivot_features(sensitivity.features_at_beta(cache, beta), 2), "sample_id")
        assert a == pytest.approx(probe.run_protocol(wide, features.feature_columns(2))["test_auroc"])
    none = sensitivity.full_probe_sweep(sensitivity.full_sweep(cache, (1.0,)), samples.where("y = 1"), 2, (1.0,)).first()
    assert math.isnan(none.probe_auroc)
    wide = samples.join(features.pivot_features(sensitivity.features_at_beta(cache, 5.0), 2), "sample_id")
    swap = sensitivity.beta_probe_sweep(wide, sensitivity.entropy_sweep(cache, (5.0,)), 2, (5.0,)).first()
    assert swap.probe_auroc == pytest.approx(full[5.0])


def test_labelling_job(spark):
    rows = [("s1", "q", ["sky", "blue"], "x", False), ("s2", "q", ["sky"], "bad", False), ("s3", "q", ["sky"], None, False), ("s4", "q", ["sky"], "x", True), ("s5", "q", ["sky"], "odd", False)]
    samples = spark.createDataFrame(rows, "sample_id string, question string, gold_answers array<string>, generated_text string, failed boolean")

    def judge(prompt):
        if "\nbad\n" in prompt:
            raise RuntimeError("down")
        return "gibberish" if "\nodd\n" in prompt else " unsupported."

    got = labels.label_samples(samples, judge, retries=2, base_delay=0.0).cache()
    assert {r.sample_id: (r.is_hallucination, r.error is None) for r in got.collect()} == {"s1": (1, True), "s2": (None, False), "s5": (None, True)}
    assert labels.label_counts(samples, got).first().asDict() == {"labelled": 2, "skipped_failed": 2, "unparseable": 1, "errors": 1}
    assert labels.label_samples(samples, judge, done=got.select("sample_id")).count() == 0
    same = spark.createDataFrame([("a", 1, 1), ("b", 0, 0)], "sample_id string, judge int, human int")
    assert labels.kappa(same).first().kappa == 1.0
    with pytest.raises(ValueError):
        labels.kappa(same.limit(1))


def test_readers_and_writers(spark, tmp_path):
    base = f"file://{tmp_path}"
    (tmp_path / "meta").mkdir()
    (tmp_path / "meta/s1.json").write_text(json.dumps({"sample_id": "x", "question": "q"}))
    (tmp_path / "meta/s2.json").write_text('{"sample_id": "s2", "quest')
    assert [r.sample_id for r in readers.complete_ids(spark, f"{base}/meta").collect()] == ["s1"]
    (tmp_path / "log.jsonl").write_text('{"sample_id": "a", "error": "e"}\n\n{"sample_id": "b", "er')
    assert readers.read_jsonl(spark, f"{base}/log.jsonl", "sample_id string, error string").count() == 1
    assert readers.read_jsonl(spark, f"{base}/none.jsonl", "sample_id string").count() == 0
    (tmp_path / "h.csv").write_text("sample_id,human_label\na,1\nb,\nc, 0\nd,x\n")
    assert {r.sample_id: r.human_label for r in readers.read_human_labels(spark, f"{base}/h.csv").collect()} == {"a": 1, "c": 0}
    with pytest.raises(ValueError):
        readers.read_score_cache(spark, f"{base}/nothing")
    with pytest.raises(ValueError):
        readers.load_samples(spark.range(1), "other")
    writers.append_failures(spark.createDataFrame([("a", "e")], "sample_id string, error string"), f"{base}/f")
    assert spark.read.json(f"{base}/f").count() == 1
    over = readers.override_labels(spark.createDataFrame([("a",), ("b",)], "sample_id string"), '{"a": 1}')
    assert {r.sample_id: r.is_hallucination for r in over.collect()} == {"a": 1, "b": None}


def test_adapters(spark):
    rows = spark.createDataFrame([(0, "q", " best ", ["a", " "], " "), (1, "q", "", [" "], "c"), (2, "q", "a", ["a "], "c")], "idx int, question string, best_answer string, correct_answers array<string>, category string")
    got = {r.sample_id: (r.gold_answers, r.category) for r in readers.load_samples(rows, "truthfulqa").collect()}
    assert got == {"truthfulqa_0": (["best", "a"], None), "truthfulqa_2": (["a"], "c")}
    rows = spark.createDataFrame([(0, "q", (["x", ""],)), (1, "q", ([],))], "idx int, question string, answer struct<aliases:array<string>>")
    assert [r.gold_answers for r in readers.load_samples(rows, "triviaqa").collect()] == [["x"]]


def test_selection(spark):
    rows = spark.createDataFrame([(f"s_{i}", i) for i in range(25)], "sample_id string, idx int")
    parts = [{r.idx for r in selection.stride_shard(rows, k, 3).collect()} for k in range(3)]
    assert parts == [set(range(k, 25, 3)) for k in range(3)]
    with pytest.raises(ValueError):
        selection.stride_shard(rows, 3, 3)
    assert selection.subsample(rows, None).count() == 25 and selection.subsample(rows, 4).count() == 4
    odd = spark.createDataFrame([(i, None if i in (3, 8) else float("nan") if i == 5 else float(i % 4)) for i in range(20)], "sample_id long, idx double")
    parts = [{r.sample_id for r in selection.stride_shard(odd, k, 2).collect()} for k in range(2)]
    assert parts[0] | parts[1] == set(range(20)) and len(parts[0]) == len(parts[1]) == 10
    order = {r.sample_id: r._pos for r in selection.with_position(odd, "idx").collect()}
    assert {order[3], order[8]} == {0, 1} and order[5] == 19 and sorted(order.values()) == list(range(20))
    assert order == {r.sample_id: r._pos for r in selection.with_position(odd.repartition(7), "idx").collect()}
    assert selection.with_position(odd.limit(0), "idx").count() == 0
    done = rows.where("idx < 4")
    assert [r.idx for r in selection.work_list(rows, done, 0, 2, limit=5, most=2).collect()] == [4, 6]


def test_rows_to_label_and_to_recompute(spark):
    rows = spark.createDataFrame([("a", False, "x", 1), ("b", True, "x", None), ("c", None, "", 0), ("d", None, "y", None)], "sample_id string, failed boolean, generated_text string, is_hallucination int")
    assert [r.sample_id for r in selection.gradable(rows).collect()] == ["a", "d"]
    assert {r.sample_id for r in selection.labelled(rows).collect()} == {"a", "c"}
    have, skipped = selection.having_scores(rows, rows.where("sample_id in ('a', 'd')").select("sample_id"))
    assert {r.sample_id for r in have.collect()} == {"a", "d"} and skipped == 2
    again = selection.realign(rows, spark.createDataFrame([("d", 0), ("z", 1), ("a", 2)], "sample_id string, idx int"))
    assert [(r.sample_id, r.generated_text) for r in again.collect()] == [("d", "y"), ("z", None), ("a", "x")]


def test_positions_become_relative(spark):
    rows = spark.createDataFrame([("a", t, 3) for t in range(6)], "sample_id string, position int, n_prompt int")
    assert [(r.position, r.is_ref) for r in trajectory.tag_positions(rows).orderBy("position").collect()] == [(0, True), (1, False), (2, False), (3, False)]


def test_feature_table_joins_metadata_and_splits(spark, world):
    traj = trajectory.trajectories(world[0], bank.build_bank(world[1]), 4.0).cache()
    meta = spark.createDataFrame([("s_0", "q0"), ("s_1", "q1"), ("s_9", "q9")], "sample_id string, question string")
    base = spark.createDataFrame([("s_0", -1.0, 2.0)], "sample_id string, seq_logprob double, token_entropy_mean double")
    truth = spark.createDataFrame([("s_1", 1)], "sample_id string, is_hallucination int")
    wide = features.feature_table(traj, meta, base, truth)
    got = {r.sample_id: (r.question, r.seq_logprob, r.is_hallucination) for r in wide.collect()}
    assert got == {"s_0": ("q0", -1.0, None), "s_1": ("q1", None, 1)}
    assert features.baseline_matrix(wide).columns == ["sample_id", *features.BASELINES]
    with pytest.raises(ValueError):
        features.feature_table(traj.where("sample_id <> 's_0' or layer = 0"))
    split = spark.createDataFrame([("s_0", "train"), ("s_1", "val"), ("s_8", "test")], "sample_id string, split string")
    assert {r.sample_id for r in splits.rows_of_split(wide, split, "train", "val").collect()} == {"s_0", "s_1"}
    assert splits.rows_of_split(wide, split, "test").count() == 0
    cache = trajectory.score_cache(world[0].where("sample_id <> 's_1'"), bank.build_bank(world[1]))
    again, skipped = sensitivity.feature_table_at_beta(cache, meta, 4.0, 2, truth, base)
    assert [r.sample_id for r in again.collect()] == ["s_0"] and skipped == 2
    with pytest.raises(ValueError):
        sensitivity.cached_scores(cache.limit(0))


def test_sweep_tables(spark):
    sweep = spark.createDataFrame([(b, s, layer, b + layer) for b in (1.0, 2.0) for s in ("a", "b") for layer in (0, 1)], "beta double, sample_id string, layer int, delta_norm_entropy double")
    truth, probes = spark.createDataFrame([("a", 1)], "sample_id string, is_hallucination int"), spark.createDataFrame([(1.0, 0.7), (2.0, 0.6)], "beta double, probe_auroc double")
    table = sensitivity.sensitivity_table(sweep, truth, probes)
    assert {(r.beta, r.sample_id, r.mean_delta_hbar, r.is_hallucination, r.probe_auroc) for r in table.collect()} == {(b, s, b + 0.5, 1 if s == "a" else None, p) for b, p in ((1.0, 0.7), (2.0, 0.6)) for s in "ab"}
    assert [tuple(r) for r in sensitivity.auroc_curve(table).collect()] == [(1.0, 0.7), (2.0, 0.6)]
    assert sensitivity.beta_class_means(table).count() == 2


def test_prompts_hash_and_agreement(spark):
    one = spark.range(1)
    assert one.select(labels.prompt_hash("abc")).first()[0] == hashlib.sha256(b"abc").hexdigest()
    judge = spark.createDataFrame([("a", 1), ("b", 0), ("c", None), ("d", 1)], "sample_id string, is_hallucination int")
    human = spark.createDataFrame([("a", 1), ("b", 0), ("c", 1), ("z", 1)], "sample_id string, human_label int")
    r = labels.judge_human_kappa(judge, human).first()
    assert (r.n, r.agreement, r.kappa, r.reliable) == (2, 1.0, 1.0, True)
    waits = []
    with pytest.raises(RuntimeError):
        labels.asked(lambda p: (_ for _ in ()).throw(RuntimeError("x")), "p", 3, 2.0, waits.append)
    assert len(waits) == 2 and 2 <= waits[0] <= 4 and 4 <= waits[1] <= 8


def test_smoke_run_fits_in_sample(spark):
    rows = spark.createDataFrame([(f"s{i}", i % 2, float(i % 2) + i / 100, float(i)) for i in range(12)], "sample_id string, y int, a double, b double")
    got = probe.run_base_and_full(rows, ["b"], ["a"])
    assert got["base"]["smoke"] and got["full"]["test_auroc"] == 1.0
    assert math.isnan(probe.in_sample(rows.where("y = 1"), ["a"])["test_auroc"])


def test_tables_round_trip(spark, world, tmp_path):
    base = f"file://{tmp_path}"
    b = bank.build_bank(world[1])
    traj, cache = trajectory.trajectories(world[0], b, 4.0).cache(), trajectory.score_cache(world[0], b)
    meta = spark.createDataFrame([("s_0", "q")], "sample_id string, question string")
    writers.write_trajectories(traj, f"{base}/run", cache, meta)
    back = readers.read_trajectories(spark, f"{base}/run/trajectories")
    assert back.select(*traj.columns).exceptAll(traj).count() == 0 and back.count() == traj.count()
    assert readers.read_score_cache(spark, f"{base}/run/scores").count() == cache.count()
    assert spark.read.json(f"{base}/run/meta").count() == 1
    (tmp_path / "meta").mkdir()
    (tmp_path / "meta/s_2.json").write_text(json.dumps({"question": "q"}))
    assert {r.sample_id for r in readers.read_trajectories(spark, f"{base}/run/trajectories", f"{base}/meta").collect()} == {"s_2"}
    b.write.parquet(f"{base}/bank")
    assert readers.read_bank(spark, f"{base}/bank").count() == 18
    b.drop("row_norm").write.parquet(f"{base}/bad")
    with pytest.raises(ValueError):
        readers.read_bank(spark, f"{base}/bad")
    spark.createDataFrame([], cache.schema).write.parquet(f"{base}/none")
    with pytest.raises(ValueError):
        readers.read_score_cache(spark, f"{base}/none")
    table = spark.createDataFrame([("a", 1, 0.5), ("b", None, 1.5)], "sample_id string, is_hallucination int, x double")
    for name in ("t.csv", "t"):
        writers.write_table(table, f"{base}/{name}")
        assert [tuple(r) for r in readers.read_features(spark, f"{base}/{name}").collect()] == [("a", 1, 0.5)]
    (tmp_path / "labels.jsonl").write_text('{"sample_id": "a", "is_hallucination": 1}\n{"sample_id": "b", "is_hallucination": null}\n')
    assert [tuple(r) for r in readers.read_labels(spark, f"{base}/labels.jsonl").collect()] == [("a", 1)]
    writers.write_human_template(table, f"{base}/human", 5)
    assert [tuple(r) for r in spark.read.option("header", True).csv(f"{base}/human").collect()] == [("a", None)]
    record = calibration.calibrate(world[0], b, 3)
    writers.write_calibration(record, trajectory.reference_scores(world[0], b), f"{base}/cal")
    stored = spark.read.json(f"{base}/cal/record").first()
    assert stored.n == 3 and len(stored.ids) == 3 and len(stored.curve) == len(calibration.BETA_GRID)
    assert spark.read.parquet(f"{base}/cal/scores").count() == 12


def test_incremental_rerun_adds_nothing(spark, world, tmp_path):
    src, out, check = (f"file://{tmp_path}/{x}" for x in ("in", "out", "check"))
    world[0].where("sample_id < 's_3'").write.parquet(src)
    b = bank.build_bank(world[1])
    schema = "sample_id string, layer int, position int, r array<double>"
    for _ in range(2):
        incremental.run_incremental(spark, src, schema, b, 5.0, out, check)
        assert incremental.read_incremental(spark, out).count() == 24
    world[0].where("sample_id >= 's_3'").write.mode("append").parquet(src)
    incremental.run_incremental(spark, src, schema, b, 5.0, out, check)
    assert incremental.read_incremental(spark, out).count() == 48


def test_a_protocols_rows_are_shuffled_to_few_tasks(spark, monkeypatch):
    """coalesced, a task would hold the sorts of many partitions."""
    from vecdrift.operators import probe

    rows = spark.range(60).selectExpr("id AS sample_id", "cast(id % 2 AS int) AS y", "CASE WHEN id % 5 = 0 THEN 'test' WHEN id % 5 = 1 THEN 'val' ELSE 'train' END AS split", "id * 1.0D AS v")
    seen = []

    def stop(data, *a):
        seen.append(data)
        raise InterruptedError

    monkeypatch.setattr(probe, "scalings", stop)
    with pytest.raises(InterruptedError):
        probe.run_protocol(rows, ["v"])
    seen[0].unpersist()
    for data in (seen[0], probe.compact(rows)):
        plan = data._jdf.queryExecution().logical().toString()
        assert data.rdd.getNumPartitions() == 1
        assert "Repartition 1, false" not in plan

"""Resampling kernels against the drawn rows and plain loops."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecdrift.operators import resample, stats


def plain(y, s, w):
    if np.isnan(s[w > 0]).any():
        return math.nan
    p, n = [(b, k) for a, b, k in zip(y, s, w) if a == 1 and k], [(b, k) for a, b, k in zip(y, s, w) if a == 0 and k]
    return sum(k * m * ((a > b) + 0.5 * (a == b)) for a, k in p for b, m in n) / (sum(k for _, k in p) * sum(m for _, m in n))


def table(spark, n, seed, nan=False):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    full, base = np.round(y + rng.normal(size=n), 1), rng.normal(size=n)
    if nan:
        full[3] = math.nan
    rows = spark.createDataFrame([(i, int(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(y, full, base))], "idx long, y int, full double, base double")
    return rows, y, full, base


def test_replicates_equal_the_drawn_rows(spark):
    rows, *_ = table(spark, 60, 1, nan=True)
    got = {r.b: (r.full, r.base) for r in resample.replicates(rows, ("full", "base"), 25, 7).collect()}
    drawn = stats.draws(rows, 25, 7)
    for k, name in enumerate(("full", "base")):
        for r in stats.auroc_by(drawn.withColumnRenamed(name, "score"), ["b"]).collect():
            assert got[r.b][k] == pytest.approx(r.auroc, nan_ok=True)
    assert len(got) == 25 and any(math.isnan(x) for x, _ in got.values())


def test_null_rows_are_drawn_and_do_not_count(spark):
    rows = spark.createDataFrame([(0, 1, 2.0), (1, 0, 1.0), (2, None, 5.0), (3, 1, None), (4, 0, 3.0)], "idx long, y int, score double")
    y, s = np.array([1, 0, -1, -1, 0]), np.array([2.0, 1.0, 0.0, 0.0, 3.0])
    for r in resample.replicates(rows, ("score",), 20).collect():
        for a in range(1001):
            w = np.bincount([int(hashlib.md5(f"42:{r.b}:{a}:{j}".encode()).hexdigest()[:15], 16) % 5 for j in range(5)], minlength=5)
            if w[0] and w[1] + w[4]:
                break
        assert r.score == pytest.approx(plain(y, s, w))


@pytest.mark.parametrize("kernel_rows", [10**6, 10])
def test_no_draw_of_both_classes_is_an_error(spark, kernel_rows):
    rows = spark.createDataFrame([(i, int(i == 0), float(i)) for i in range(31)], "idx long, y int, score double")
    with pytest.raises(Exception, match="no draw of both classes"):
        resample.replicates(rows, ("score",), 200, kernel_rows=kernel_rows, most_redraws=0).collect()
    assert resample.replicates(rows, ("score",), 200, kernel_rows=kernel_rows).where("score is not null").count() == 200
    with pytest.raises(ValueError):
        resample.replicates(rows.where("y = 0"), ("score",), 5, kernel_rows=kernel_rows)


def test_weights_are_poisson_numbers_and_keyed():
    w = resample.weights(42, 0, np.arange(200), np.arange(3000))
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert abs(np.corrcoef(w[:50])[np.triu_indices(50, 1)]).max() < 0.1
    assert (resample.weights(42, 0, np.array([7]), np.array([11, 5])) == w[7, [11, 5]]).all()
    assert (resample.weights(42, 1, np.arange(200), np.arange(3000)) != w).mean() > 0.5


@pytest.mark.parametrize("nan", [False, True])
def test_many_rows_by_weights_equal_plain_loops(spark, nan):
    rows, y, full, base = table(spark, 300, 3, nan)
    got = {r.b: (r.full, r.base) for r in resample.replicates(rows.repartition(3), ("full", "base"), 12, 5, kernel_rows=10).collect()}
    w = resample.weights(5, 0, np.arange(12), np.arange(300))
    for b in range(12):
        assert got[b] == pytest.approx((plain(y, full, w[b]), plain(y, base, w[b])), nan_ok=True)


def test_both_ways_give_like_intervals(spark):
    rows, *_ = table(spark, 2000, 4)
    ways = [resample.replicates(rows, ("full",), 300, kernel_rows=k).agg(F.mean("full"), F.stddev("full")).first() for k in (10, 10**6)]
    assert ways[0][0] == pytest.approx(ways[1][0], abs=0.003) and ways[0][1] == pytest.approx(ways[1][1], rel=0.2)


@pytest.mark.parametrize("kernel_rows", [10**6, 10])
def test_permuted_rank_sums_equal_a_plain_loop(spark, kernel_rows):
    rng = np.random.default_rng(1)
    ranks = {(f"s{i}", f"f{j}"): float(rng.integers(1, 50)) / 2 for i in range(70) for j in range(3) if (i, j) != (5, 2)}
    ranked = spark.createDataFrame([(*k, v) for k, v in ranks.items()], "sample_id string, feature string, r double").repartition(3)
    ids = ranked.select("sample_id").distinct()
    got = {(r.b, r.feature): r.rank_sum for r in resample.permuted_rank_sums(ranked, ids, 20, 70, 9, kernel_rows).collect()}
    for b in range(70):
        first = sorted((hashlib.md5(f"9:{b}:s{i}".encode()).hexdigest(), f"s{i}") for i in range(70))[:20]
        for f in ("f0", "f1", "f2"):
            assert got[b, f] == sum(ranks.get((s, f), 0.0) for _, s in first)
    assert {r.rank_sum for r in resample.permuted_rank_sums(ranked, ids, 0, 3, 9, kernel_rows).collect()} == {0.0}


def test_digests_of_many_keys_are_hashlibs():
    """keys of all lengths, with prefixes of all alignments, and
    messages of more than a block."""
    import hashlib

    from vecdrift.functions import digests

    rng = np.random.default_rng(3)
    keys = [bytes(rng.integers(0, 256, k, dtype=np.uint8)) for k in [*range(70), *rng.integers(0, 20, 200)]]
    for prefix in ("", "4", "42:", "42:7:", "42:1234:10:", "x" * 54, "y" * 90):
        want = [hashlib.md5(prefix.encode() + k).digest() for k in keys]
        assert [bytes(x) for x in digests.md5(prefix, digests.Keys.of(keys)).astype("<u4").view("V16").ravel()] == want
    n = 70_000
    want = [int(hashlib.md5(b"42:9:0:%d" % j).hexdigest()[:15], 16) for j in range(n)]
    assert digests.heads("42:9:0:", digests.Keys.numbers(n)).tolist() == want
    for n in (0, 1, 7, 10, 11):
        assert digests.heads("42:9:0:", digests.Keys.numbers(n)).tolist() == want[:n]


def test_more_than_a_million_rows_are_drawn_as_the_sql_draws_them():
    """all rows of the six-fold tables keep the keyed draws of the SQL."""
    assert resample.KERNEL_ROWS >= 2_000_000

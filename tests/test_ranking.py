import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecdrift.operators import bank, ranking, stats

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def values(spark):
    """A hot group with one value in a third of its rows, small groups, odd values."""
    rng = np.random.default_rng(5)
    rows = [("hot", float(v)) for v in np.r_[np.zeros(1000), rng.normal(size=1500), rng.integers(-3, 3, 500)]]
    rows += [("one", 2.5), ("two", 1.0), ("two", 4.0), ("odd", NAN), ("odd", INF), ("odd", -INF), ("odd", -0.0), ("odd", 0.0), ("odd", None), ("none", None), ("none", NAN), (None, 3.0), (None, 1.0)]
    return spark.createDataFrame([(i, f, v) for i, (f, v) in enumerate(rows)], "sample_id long, feature string, value double"), rows


def _key(v):
    return (0, 0.0) if v is None else (2, 0.0) if math.isnan(v) else (1, v + 0.0)


def test_ranks_are_those_of_a_sort(values):
    df, rows = values
    got = {r.sample_id: r.r for r in ranking.ranks(df, ["feature"]).collect()}
    assert len(got) == len(rows)
    for f in {f for f, _ in rows}:
        keys = {i: _key(v) for i, (g, v) in enumerate(rows) if g == f}
        for i, k in keys.items():
            assert got[i] == sum(x < k for x in keys.values()) + (sum(x == k for x in keys.values()) + 1) / 2


@pytest.mark.parametrize("ranges", (2, 7, 64))
def test_places_do_not_depend_on_ranges(values, ranges):
    df, rows = values
    found = ranking.placed(ranking.values_of(df.where("feature = 'hot'"), ["feature"]), ["feature"], ranges).collect()
    own = sorted(v for f, v in rows if f == "hot")
    assert len(found) == len(set(own))
    assert all(r.total == 3000 and r.less == np.searchsorted(own, r.value) and r.n == own.count(r.value) for r in found)


def test_medians_are_exact(values):
    df, rows = values
    got = {r.feature: r["median"] for r in ranking.medians(df, ["feature"]).collect()}
    want = {f: [v for g, v in rows if g == f and v is not None and not math.isnan(v)] for f in {f for f, _ in rows}}
    assert got == {f: float(np.median(v)) for f, v in want.items() if v}
    assert ranking.medians(df.limit(0), ["feature"]).count() == 0
    filled = {r.sample_id: r.value for r in stats.median_imputed(df).collect()}
    assert len(filled) == len(rows) and filled[len(rows) - 3] == filled[len(rows) - 4] == 0.0  # no value at all
    both = df.groupBy("feature").agg(F.median(F.when(~F.isnan("value"), F.col("value"))).alias("m")).collect()
    assert {r.feature: r.m for r in both if r.m is not None} == got


def test_no_window_over_a_whole_group(values):
    """Windows are over ranges, or over one row per range."""
    plan = ranking.ranks(values[0], ["feature"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2 and "_range" in windows[0] + windows[1] and "_at" in windows[0] + windows[1]


def test_transpose(spark):
    rng = np.random.default_rng(6)
    wide, high = rng.normal(size=(300, 131)), rng.normal(size=(2, 3))
    rows = [(0, i, wide[i].tolist()) for i in range(300)] + [(1, 10 - i, high[i].tolist()) for i in range(2)] + [(2, 0, [])]
    df = spark.createDataFrame(rows, "layer int, pattern_id long, weights array<double>").repartition(5)
    got = {(r.layer, r.pattern_id): r.weights for r in bank.transpose(df).collect()}
    assert len(got) == 131 + 3
    assert all(got[0, j] == wide[:, j].tolist() for j in range(131))
    assert all(got[1, j] == [high[1, j], high[0, j]] for j in range(3))  # by pattern_id
    assert bank.transpose(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(0, 0, [1.0, None]), (0, 1, None), (0, 2, [2.0, 3.0])], df.schema)
    got = {r.pattern_id: r.weights for r in bank.transpose(odd).collect()}
    assert got[0] == [1.0, 2.0] and math.isnan(got[1][0]) and got[1][1] == 3.0
    for other in ([1.0], []):
        with pytest.raises(Exception, match="of other lengths"):
            bank.transpose(spark.createDataFrame([(0, 0, [1.0] * 200), (0, 1, other)], df.schema)).collect()


def test_transpose_shuffles_tiles(spark):
    """300 x 131 numbers in one task are 3 tiles, not 39,300 rows."""
    df = spark.range(300).select(F.lit(0).alias("layer"), F.col("id").alias("pattern_id"), F.array_repeat(F.col("id").cast("double"), 131).alias("weights")).coalesce(1)
    assert bank.tiles(df).count() == 3

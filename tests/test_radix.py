"""Medians by bits against numpy."""

import numpy as np
import pytest

from vecdrift.operators import probe, radix


def test_bits_ascend_with_values():
    x = np.sort(np.r_[np.random.default_rng(0).normal(size=500) * 10.0 ** np.arange(-250, 250), 0.0, -np.inf, np.inf])
    bits = radix.ascending(x)
    assert (np.diff(bits.astype(object)) > 0).all() and (radix.values(bits) == x).all()
    assert radix.ascending(np.array([-0.0])) == radix.ascending(np.array([0.0]))


@pytest.mark.parametrize("fetched", [0, 40, 1 << 20])
@pytest.mark.parametrize("few", [True, False])
def test_medians_of_sets(spark, fetched, few):
    rng = np.random.default_rng(4)
    x = np.c_[rng.normal(size=61), np.round(rng.normal(size=61)), rng.normal(size=61) * 1e-300, np.full(61, np.nan)]
    x[rng.random(x.shape) < 0.2] = np.nan
    sets = [[s for s in range(3) if s != i % 3] if i else [7] for i in range(61)]
    data = spark.createDataFrame([(v.tolist(), float(i % 2), m) for i, (v, m) in enumerate(zip(x, sets))], "x array<double>, y double, m array<int>").repartition(3)

    def unpack(batch):
        x, _, rows = probe._columns(batch, 4)
        return x, rows

    own = {s: x[[i for i, m in enumerate(sets) if s in m]] for s in (0, 1, 2, 7)}
    got = radix.medians(data, unpack, {s: (~np.isnan(v)).sum(0) for s, v in own.items()}, few, fetched)
    for s, v in own.items():
        want = [np.nanmedian(c) if (~np.isnan(c)).any() else 0.0 for c in v.T]
        assert got[s].tolist() == want
        scale = probe.scalings(data, 4)[s]
        filled = np.where(np.isnan(v), want, v)
        assert np.allclose(scale.means, filled.mean(0), atol=1e-12)
        assert np.allclose(scale.scales, np.where(filled.std(0) > 0, filled.std(0), 1))

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecdrift.functions import metrics as M


@pytest.fixture(scope="module")
def one(spark):
    def value(column, **arrays):
        row = spark.range(1).select(*[F.lit(None).alias("none")])
        for name, x in arrays.items():
            lit = F.array(*[F.lit(float(v)) for v in x]) if isinstance(x, (list, tuple, np.ndarray)) else F.lit(x)
            row = row.withColumn(name, lit)
        return row.select(column.alias("v")).first()["v"]

    return value


def test_js_closed_forms(one):
    assert one(M.js_nats("p", "q"), p=[1, 0], q=[0, 1]) == pytest.approx(math.log(2), abs=1e-12)
    assert one(M.js_nats("p", "q"), p=[0.3, 0.7], q=[0.3, 0.7]) == pytest.approx(0, abs=1e-15)
    p, q = np.array([0.9, 0.1]), np.array([0.2, 0.8])
    m = (p + q) / 2
    want = 0.5 * (p * np.log(p / m)).sum() + 0.5 * (q * np.log(q / m)).sum()
    assert one(M.js_nats("p", "q"), p=p, q=q) == pytest.approx(want, abs=1e-12)
    assert one(M.js_nats("q", "p"), p=p, q=q) == pytest.approx(want, abs=1e-12)
    assert one(M.js_by_entropy("p", "q"), p=p, q=q) == pytest.approx(want, abs=1e-12)


def test_hellinger_and_bhattacharyya(one):
    assert one(M.hellinger_sq("p", "q"), p=[1, 0], q=[0, 1]) == pytest.approx(1)
    p, q = [0.5, 0.5], [0.1, 0.9]
    assert one(M.hellinger_sq("p", "q") + M.bhattacharyya("p", "q"), p=p, q=q) == pytest.approx(1)


def test_entropy(one):
    assert one(M.norm_entropy("p"), p=[0.01] * 100) == pytest.approx(1)
    assert one(M.entropy("p"), p=[1] + [0] * 9) == 0
    assert math.isnan(one(M.entropy("p"), p=[float("nan"), 1]))


def test_energy_is_stable_at_high_beta(one):
    s, r = [1.0, 0.5], [3.0, 4.0]
    assert one(M.energy("s", "r", 1e5), s=s, r=r) == pytest.approx(-1 + 12.5)
    assert one(M.softmax("s", 1e5), s=s) == [1.0, 0.0]
    assert one(M.lse_term("s", 2.0), s=s) == pytest.approx(-0.5 * math.log(math.exp(2) + math.exp(1)))


def test_tokens_and_norms(one):
    x = [0.0, 1.0, 2.0]
    z = math.log(sum(map(math.exp, x)))
    assert one(M.token_logprob("x", F.lit(2)), x=x) == pytest.approx(2 - z)
    assert one(M.l2_normalised("r"), r=[3.0, 4.0]) == pytest.approx([0.6, 0.8])
    assert one(M.l2_normalised("r"), r=[0.0, 0.0]) == [0.0, 0.0]
    assert one(M.kl_nats("p", "q"), p=[1, 0], q=[0, 1]) == math.inf

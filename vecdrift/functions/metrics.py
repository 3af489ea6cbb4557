"""Column functions over ARRAY<DOUBLE> (scores, distributions, vectors).

let() binds an intermediate once: Catalyst would otherwise repeat an aggregate
for every element of a transform. NaN passes through every metric; an entry of
probability 0 contributes 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-300
EPS = 1e-12


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once."""
    return F.transform(F.array(value), lambda x: use(x))[0]


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def retrieval_scores(m_hat: Column | str, r: Column | str) -> Column:
    """s = m_hat . r for each row of a packed bank (ARRAY<ARRAY<DOUBLE>>)."""
    return F.transform(_c(m_hat), lambda m: dot(m, _c(r)))


def softmax(s: Column | str, beta: Column | float) -> Column:
    """softmax(beta * s), shifted by its largest exponent."""
    b = F.lit(beta) if not isinstance(beta, Column) else beta
    return let(
        F.array_max(F.transform(_c(s), lambda x: b * x)),
        lambda mx: let(F.transform(_c(s), lambda x: F.exp(b * x - mx)), lambda e: let(total(e), lambda z: F.transform(e, lambda x: x / z))),
    )


def lse_term(s: Column | str, beta: Column | float) -> Column:
    """-(1 / beta) * log sum exp(beta * s)."""
    b = F.lit(beta) if not isinstance(beta, Column) else beta
    return let(F.array_max(F.transform(_c(s), lambda x: b * x)), lambda mx: -(mx + F.log(total(F.transform(_c(s), lambda x: F.exp(b * x - mx))))) / b)


def quadratic_term(r: Column | str) -> Column:
    return F.lit(0.5) * total(F.transform(_c(r), lambda x: x * x))


def energy(s: Column | str, r: Column | str, beta: Column | float) -> Column:
    return lse_term(s, beta) + quadratic_term(r)


def entropy(p: Column | str) -> Column:
    """In nats."""
    return -total(F.transform(_c(p), lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)))


def norm_entropy(p: Column | str) -> Column:
    return entropy(p) / F.log(F.size(_c(p)).cast("double"))


def _floored(p: Column) -> Column:
    return let(F.transform(p, lambda x: F.greatest(x, F.lit(FLOOR))), lambda f: let(total(f), lambda z: F.transform(f, lambda x: x / z)))


def js_nats(p: Column | str, q: Column | str) -> Column:
    """Jensen-Shannon divergence in nats, at most ln 2."""
    half = lambda x, m: F.when(x > 0, 0.5 * x * F.log(x / m)).otherwise(0.0)
    both = lambda a, b: total(F.zip_with(a, b, lambda x, y: half(x, (x + y) / 2) + half(y, (x + y) / 2)))
    return let(_floored(_c(p)), lambda a: let(_floored(_c(q)), lambda b: F.greatest(both(a, b), F.lit(0.0))))


def js_by_entropy(p: Column | str, q: Column | str) -> Column:
    """H(M) - H(P) / 2 - H(Q) / 2: the same by another way."""
    return entropy(F.zip_with(_c(p), _c(q), lambda x, y: (x + y) / 2)) - entropy(p) / 2 - entropy(q) / 2


def hellinger_sq(p: Column | str, q: Column | str) -> Column:
    return F.lit(0.5) * total(F.zip_with(_c(p), _c(q), lambda x, y: (F.sqrt(x) - F.sqrt(y)) * (F.sqrt(x) - F.sqrt(y))))


def bhattacharyya(p: Column | str, q: Column | str) -> Column:
    return total(F.zip_with(_c(p), _c(q), lambda x, y: F.sqrt(x * y)))


def kl_nats(p: Column | str, q: Column | str) -> Column:
    """Infinite where q is 0 and p is not."""
    return total(F.zip_with(_c(p), _c(q), lambda x, y: F.when(x > 0, F.when(y > 0, x * F.log(x / y)).otherwise(F.lit(float("inf")))).otherwise(0.0)))


def l2_norm(x: Column | str) -> Column:
    return F.sqrt(total(F.transform(_c(x), lambda v: v * v)))


def l2_normalised(x: Column | str, eps: float = EPS) -> Column:
    return let(F.greatest(l2_norm(x), F.lit(eps)), lambda n: F.transform(_c(x), lambda v: v / n))


def retrieved_prototype(p: Column | str, m_hat: Column | str) -> Column:
    """sum_i p_i m_i over the rows of a packed bank."""
    first = F.transform(F.element_at(_c(m_hat), 1), lambda v: v * 0.0)
    return F.aggregate(F.arrays_zip(_c(p).alias("p"), _c(m_hat).alias("m")), first, lambda a, x: F.zip_with(a, x["m"], lambda u, v: u + x["p"] * v))


def token_logprob(logits: Column | str, chosen: Column | str) -> Column:
    """log_softmax(logits)[chosen], chosen from 0."""
    x = _c(logits)
    return let(F.array_max(x), lambda mx: F.element_at(x, _c(chosen) + 1) - mx - F.log(total(F.transform(x, lambda v: F.exp(v - mx)))))


def predictive_entropy(logits: Column | str) -> Column:
    return let(softmax(logits, 1.0), entropy)


def folded(a: Column | str) -> Column:
    """max(a, 1 - a)."""
    return F.greatest(_c(a), 1 - _c(a))


def keyed_number(*parts: Column | str | int) -> Column:
    """60 bits of md5 over the parts joined by ':', the source of all randomness."""
    key = F.concat_ws(":", *[F.lit(str(p)) if isinstance(p, int) else _c(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def keyed_order(*parts: Column | str | int) -> Column:
    """md5 over the parts joined by ':', to order by."""
    return F.md5(F.concat_ws(":", *[F.lit(str(p)) if isinstance(p, int) else _c(p).cast("string") for p in parts]))

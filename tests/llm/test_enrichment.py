"""Enrichment against exact rational arithmetic and a plain Benjamini-Hochberg."""

import math
import random
from collections import Counter
from decimal import Decimal, localcontext
from fractions import Fraction
from math import comb

import numpy as np
import pytest

from lemmary.llm import enrichment
from lemmary.llm.enrichment import adjust, deviance, log_upper_tail, stirling_error, term_enrichment

SCHEMA = "run int, rec string, term string, freq bigint, df string, total int"


def test_stirling_error():
    x = np.array([0.3, 0.5, 1, 2, 3.7, 11.9, 15.5, 16, 40])
    plain = [math.lgamma(v + 1) - ((v + 0.5) * math.log(v) - v + 0.5 * math.log(2 * math.pi)) for v in x]
    assert np.allclose(stirling_error(x), plain, rtol=0, atol=3e-14)
    assert stirling_error(np.array([1e12]))[0] == pytest.approx(1 / 12e12, rel=1e-12)


def test_deviance():
    x, m = np.array([1e15, 5.0, 5.0, 1e9]), np.array([1e15 + 1e5, 5.1, 50.0, 1e9])
    with localcontext() as c:
        c.prec = 60
        exact = [float(Decimal(a) * (Decimal(a) / Decimal(b)).ln() + Decimal(b) - Decimal(a)) for a, b in zip(x, m, strict=True)]
    assert np.allclose(deviance(x, m), exact, rtol=1e-12, atol=0)


def rare(k, n, K, N):
    """ln P(X >= k) by 60 digits, for few draws of a rare item."""
    with localcontext() as c:
        c.prec = 60
        p = Decimal(1)
        for j in range(n):
            p *= Decimal(N - K - j) / Decimal(N - j)
        below = Decimal(0)
        for i in range(k):
            below += p
            p = p * Decimal((K - i) * (n - i)) / Decimal((i + 1) * (N - K - n + i + 1))
        return float((1 - below).ln())


@pytest.mark.parametrize("size", [10**6, 10**12, 10**15])
def test_large_collections(size):
    for k, n, K in ((5, 10**4, size // 10**4), (1, 10**4, size // 10**5), (25, 10**4, size // 10**4), (3, 10**4, size // 1000), (20, 10**4, size // 1000)):
        assert log_upper_tail([k], [n], [K], [size])[0] == pytest.approx(rare(k, n, K, size), rel=1e-9, abs=1e-12)


def test_wide_tails():
    """Sums of millions of terms: close to the normal distribution they tend to."""
    n = K = 5 * 10**14
    sd = math.sqrt(n * 0.5 * 0.5 * 0.5)
    for d in (2e7, 1e7, 0, -2e7):
        got = log_upper_tail([n / 2 + d], [n], [K], [2 * n])[0]
        assert got == pytest.approx(math.log(0.5 * math.erfc((d - 0.5) / sd / 2**0.5)), rel=1e-6)


def test_integrals_are_sums(monkeypatch):
    cases = np.array([(k, 10**6, 5 * 10**7, 10**8) for k in (498_500, 499_900, 500_000, 500_400, 501_500, 503_000)], float).T
    summed = log_upper_tail(*cases)
    monkeypatch.setattr(enrichment, "MOST_TERMS", 100)
    assert np.allclose(log_upper_tail(*cases), summed, rtol=1e-9, atol=1e-12)


def exact(k, n, K, N):
    return Fraction(sum(comb(K, i) * comb(N - K, n - i) for i in range(k, min(n, K) + 1)), comb(N, n))


def test_tail_is_exact():
    rng = random.Random(2)
    cases = [(0, 5, 5, 10), (5, 5, 5, 10), (1, 1, 1, 1), (0, 0, 0, 1), (3, 3, 10, 10), (6, 5, 5, 10), (10, 50, 300, 300), (40, 50, 290, 300)]
    for _ in range(400):
        N = rng.randrange(1, 400)
        n, K = rng.randrange(N + 1), rng.randrange(N + 1)
        cases.append((rng.randrange(min(n, K) + 1), n, K, N))
    got = log_upper_tail(*np.array(cases).T)
    for case, value in zip(cases, got, strict=True):
        p = exact(*case)
        if p == 0:
            assert value == -math.inf
        else:
            log_p = math.log(p.numerator) - math.log(p.denominator)
            assert value == pytest.approx(log_p, rel=1e-9, abs=1e-9)


def brute(rows):
    f = Counter()
    for run, rec, term, n, *_ in rows:
        if None not in (run, rec, term):
            f[run, rec, term] += max(n or 0, 0)
    n, K, N = Counter(), Counter(), sum(f.values())
    for (run, rec, term), v in f.items():
        n[run, rec] += v
        K[term] += v
    p = {k: exact(v, n[k[:2]], K[k[2]], N) for k, v in f.items()}
    order = sorted(p, key=p.get)
    q, low, m = {}, Fraction(1), len(p)
    rank = {v: sum(1 for x in p.values() if x <= v) for v in set(p.values())}
    for k in reversed(order):
        low = min(low, p[k] * m / rank[p[k]])
        q[k] = low
    return f, p, q


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        rec = rng.choice(["hot"] * 5 + [f"r{j}" for j in range(12)])
        rows.append((1, rec, f"t{rng.randrange(25)}", rng.choice([1, 1, 2, 3, 9, None, 0, -4]), "clash", 5))
    rows += [(None, "a", "b", 1, "", 1), (1, None, "b", 1, "", 1), (1, "a", None, 1, "", 1), (1, "", "", 2, "", 1), (1, "a", "x" * 100_000, 1, "", 1)]
    got = term_enrichment(spark.createDataFrame(rows, SCHEMA), ["run", "rec"], "term", "freq").collect()
    f, p, q = brute(rows)
    assert len(got) == len(f)
    for x in got:
        k = (x.run, x.rec, x.term)
        assert x.freq == f[k]
        assert x.p_value == pytest.approx(float(p[k]), rel=1e-8)
        assert x.q_value == pytest.approx(float(q[k]), rel=1e-8)
        assert x.score == pytest.approx(-math.log10(q[k]), abs=1e-8)


def test_empty(spark):
    assert term_enrichment(spark.createDataFrame([], SCHEMA), ["run", "rec"], "term", "freq").count() == 0


def test_bins_do_not_show(spark):
    """Adjusted values are the same however many bins rank them, also with a heavy value."""
    rng = random.Random(5)
    values = [0.0] * 400 + [-rng.expovariate(0.3) for _ in range(600)] + [-700.0, -1e5, -1e5]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, ln_p double")
    order = sorted(values)
    rank = {v: i + 1 for i, v in enumerate(order)}
    low, want = 0.0, {}
    for v in reversed(order):
        low = min(low, v + math.log(len(values) / rank[v]))
        want[v] = low
    for size in (7, 100, 10**6):
        got = adjust(df, size).collect()
        assert len(got) == len(values)
        assert all(x.q_ln == pytest.approx(want[x.ln_p], abs=1e-9) for x in got)

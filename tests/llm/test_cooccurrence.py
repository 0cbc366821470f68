"""Pairs against brute force, with every mix of heavy and light items."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from lemmary.functions.terms import canonical_term
from lemmary.llm import cooccurrence
from lemmary.llm.cooccurrence import _delivered_once, _pairs, item_pairs

SCHEMA = "rel string, tid bigint, arg1 string, arg2 string, arg3 string, context string, n int"


def brute(rows, least):
    once = {}
    for rel, tid, *args in rows:
        once.setdefault(tid if tid is not None else object(), (rel, frozenset(t for t in map(canonical_term, args[:3]) if t is not None)))
    n, single, pair = Counter(), Counter(), Counter()
    for rel, items in once.values():
        n[rel] += 1
        single.update((rel, i) for i in items)
        pair.update((rel, *p) for p in combinations(sorted(items), 2))
    return {k: (v, single[k[0], k[1]], single[k[0], k[2]], n[k[0]]) for k, v in pair.items() if v >= least}


def found(spark, rows, least, heavy):
    df = spark.createDataFrame(rows, SCHEMA)
    got = item_pairs(df, "rel", "tid", ["arg1", "arg2", "arg3"], least, heavy)
    out = {}
    for x in got.collect():
        out[x.context, x.a, x.b] = (x.n_ab, x.n_a, x.n_b, x.n)
        assert x.lift == pytest.approx(x.n_ab * x.n / (x.n_a * x.n_b))
    assert len(out) == got.count()
    return out


@pytest.mark.parametrize("heavy", [0, 12, 512, 10**9])
def test_against_brute_force(spark, heavy):
    """No, some, most and all items heavy."""
    rng = random.Random(heavy)
    pool = ["hot-NN", "Hot-NN", "warm-VB", *[f"w{i}-NN" for i in range(60)], None, "<NONE>", "", "<->"]
    weights = [30, 5, 20, *[1] * 60, 3, 3, 1, 3]
    rows = []
    for i in range(3000):
        args = rng.choices(pool, weights, k=3)
        rows.append((rng.choice(["r1", "r2", None]), i if i % 50 else None, *args, "clash", 1))
    rows += [r for r in rows[:400] if r[1] is not None]
    assert found(spark, rows, 2, heavy) == brute(rows, 2)


def test_empty_and_wide(spark):
    assert found(spark, [], 1, 512) == {}
    df = spark.createDataFrame([("c", 1, [f"i{j}" for j in range(40)]), ("c", 2, ["i1", "i2", "i2"]), ("c", 3, None), ("c", 4, [])], "rel string, tid bigint, bag array<string>")
    got = {(x.a, x.b): (x.n_ab, x.n) for x in item_pairs(df, "rel", "tid", ["bag"], 1).collect()}
    assert len(got) == 40 * 39 // 2 and got["i1", "i2"] == (2, 4)


def test_many_redelivered_baskets(spark):
    """Rows are shuffled when more identifiers repeat than may be sent to the tasks."""
    rows = [("r", i % 500 if i % 7 else None, ["a", f"w{i % 500 % 9}"]) for i in range(2000)]
    used = spark.createDataFrame(rows, "context string, basket int, items array<string>")
    for few in (10, 10**6):
        got = _delivered_once(used, few).collect()
        assert sorted((x.basket is None, x.basket or 0, x["items"][1]) for x in got) == sorted({(False, b, i[1]) for _, b, i in rows if b is not None}) + sorted((True, 0, i[1]) for _, b, i in rows if b is None)


def test_memory_is_bounded_in_pairs():
    """Ten thousand wide baskets: partial counts are handed on, their sums are right."""
    rng = np.random.default_rng(1)
    bags = [sorted(set(rng.integers(0, 3000, 20).tolist())) for _ in range(2000)]
    row = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    item = np.concatenate([np.array(b) for b in bags])
    got, parts = Counter(), 0
    for c, a, b, n in _pairs(row % 3, row, item, 3000, 512, most=10_000):
        parts += 1
        assert len(n) <= 20_000
        got.update(dict(zip(zip(c.tolist(), a.tolist(), b.tolist(), strict=True), n.tolist(), strict=True)))
    want = Counter((i % 3, *p) for i, bag in enumerate(bags) for p in combinations(bag, 2))
    assert got == want and parts > 10


def test_codes_fit_for_any_contexts_and_items():
    """Contexts times items squared would not fit into 64 bits."""
    n = 4_000_000
    context, row = np.array([n - 1, n - 1, 5, 5]), np.array([0, 0, 1, 1])
    got = [tuple(map(int, x)) for part in _pairs(context, row, np.array([3, n - 1, 3, n - 2]), n, 0) for x in zip(*part, strict=True)]
    assert sorted(got) == [(5, 3, n - 2, 1), (n - 1, 3, n - 1, 1)]


@pytest.mark.parametrize("share", [0, 40, 10**9])
def test_blocks_of_baskets(monkeypatch, share):
    """Bit matrices of few baskets count as one of all does."""
    monkeypatch.setattr(cooccurrence, "BITS", 64)
    rng = np.random.default_rng(2)
    bags = [sorted(set(np.minimum(rng.geometric(0.1, 8), 60).tolist())) for _ in range(500)]
    row, item = np.repeat(np.arange(len(bags)), [len(b) for b in bags]), np.concatenate([np.array(b) for b in bags])
    got = Counter()
    for c, a, b, n in _pairs(row % 2, row, item, 61, share):
        for x in zip(c.tolist(), a.tolist(), b.tolist(), n.tolist(), strict=True):
            got[x[:3]] += x[3]
    assert got == Counter((i % 2, *p) for i, bag in enumerate(bags) for p in combinations(bag, 2))

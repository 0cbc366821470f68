"""The heaviest values: code, decoding, and whole results against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest

from lemmary.functions.terms import canonical_term
from lemmary.llm.heavy_hitters import SKETCH, _cells, _correct, _merge, _spelled, _sums, heaviest_values, symbols

SCHEMA = "tid bigint, rel string, arg1 string, arg2 string, freq bigint, identity string, weight int"


def test_code_corrects_two_symbols():
    rng = random.Random(1)
    for _ in range(300):
        value = rng.getrandbits(64)
        word = symbols(np.array([value], np.uint64))[:, 0].tolist()
        for half in (word[:12], word[12:]):
            broken = list(half)
            for p in rng.sample(range(12), rng.randrange(3)):
                broken[p] ^= rng.randrange(1, 16)
            assert _correct(broken) == half[:8]


def brute(rows, k):
    once = {}
    for tid, rel, a, b, f, *_ in rows:
        key = (rel, canonical_term(a), canonical_term(b))
        if None not in key:
            at = (key, tid if tid is not None else object())
            once[at] = max(f or 0, once.get(at, f or 0))
    sums = defaultdict(int)
    for (key, _), f in once.items():
        sums[key] += f
    return sorted(((*k_, v) for k_, v in sums.items()), key=lambda x: (-x[3], x[:3]))[:k]


def found(spark, rows, k, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    return [tuple(x) for x in heaviest_values(df, ["rel", "arg1", "arg2"], "freq", "tid", k, ("arg1", "arg2"), **more).collect()]


@pytest.mark.parametrize("groups", [8, 1024])
def test_against_brute_force(spark, groups):
    """With 8 groups several rounds and the exact remainder are needed."""
    rng = random.Random(groups)
    rows = [(i, "r", f"t{i}-NN", "x-NN", rng.randrange(1, 4), "e", 1) for i in range(3000)]
    for h in range(12):
        rows += [(10_000 + h * 100 + i, "r", f" H{h}-NN" if i % 2 else f"h{h}-NN", "x-NN", 20 + h, "e", 1) for i in range(60)]
    rows += [(20_000, None, "a-NN", "b-NN", 10**6, "e", 1), (20_001, "r", "<NONE>", "b-NN", 10**6, "e", 1), (None, "r", "n-NN", "b-NN", None, "e", 1)]
    rows += rows[:1000]
    rng.shuffle(rows)
    assert sorted(found(spark, rows, 10, groups=groups), key=lambda x: -x[3]) == brute(rows, 10)


def test_flat_ties_and_small(spark):
    """All weights equal: nothing stands out, ties go to the smaller values."""
    rows = [(i, "r", f"t{i % 400:03d}-NN", "x-NN", 1, "e", 1) for i in range(800)]
    assert found(spark, rows, 5, groups=16) == brute(rows, 5)
    assert found(spark, rows[:3], 25) == brute(rows[:3], 25)
    zero = [(1, "r", "a-NN", "b-NN", 0, "e", 1), (2, "r", "c-NN", "b-NN", -5, "e", 1), (3, "r", "", "b-NN", None, "e", 1)]
    assert found(spark, zero, 25) == brute(zero, 25)
    assert found(spark, [], 25) == []


def test_sums_of_many_sketches_are_whole():
    big = np.array([2**60, 2**60 - 1, 3, 5], np.int64)
    assert _sums(np.array([1, 1, 0, 2]), big, 3).tolist() == [3, 2**61 - 1, 5]
    cells = [np.full(64 * 24 * 16, i, np.int64) for i in range(1, 6)]
    (merged,) = _merge([_cells(0, 64, i, c) for i, c in enumerate(cells)])
    assert merged.column("first")[0].as_py() == 64 and set(np.frombuffer(merged.column("cells")[0].as_py(), np.int64)) == {15}
    with pytest.raises(OverflowError):
        list(_merge([_cells(0, 0, i, np.full(64 * 24 * 16, 2**62, np.int64)) for i in range(2)]))


def test_weights_beyond_a_float(spark):
    """Sums that differ by one above 2^53."""
    rows = [(i, "r", f"t{i}-NN", "x-NN", 2**54 + i, "e", 1) for i in range(40)]
    assert found(spark, rows, 10) == brute(rows, 10)


def test_many_tasks(spark):
    """Sketches of many tasks are added up in two steps."""
    sketches = spark.range(100).repartition(20).mapInArrow(lambda batches: (_cells(0, 0, i, np.ones(64 * 24 * 16, np.int64)) for b in batches for i in b.column(0).to_pylist()), SKETCH)
    got = _spelled(sketches, 100).collect()
    assert len(got) == 64 and {x.mass for x in got} == {1600}

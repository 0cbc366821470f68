"""Mixtures: shares, nesting, repeats, and thresholds against a plain walk."""

import math
import os
import random

import pytest

from lemmary.llm.mixing import TOKENIZER, mix_sources, token_counter, token_counts

pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer files")

DOCS = "doc_id bigint, text string, source string, hash string, tokens int, copies string"
MIX = "source string, target_share double, max_repeat int"


def make(spark, n=4000, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choices(["a", "b", "c", "d", None], [50, 20, 4, 10, 2])[0]
        rows.append((i, None if i % 101 == 0 else "word " * rng.randrange(1, 60), source, "clash", 3, "x"))
    return spark.createDataFrame(rows, DOCS)


def test_tokens(spark):
    count = token_counter(TOKENIZER)
    assert count("") == 0 and 2 <= count("hello world") <= 5
    assert count(" " * 1_000_000 + "end") > 0 and count("a" * 500_000) > 0
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, "")], "i int, t string")
    assert sorted((x.i, x.tokens) for x in token_counts(df, "i", "t", []).collect()) == [(1, count("hello world")), (2, 0), (3, 0)]


def test_shares_are_reached(spark):
    docs = make(spark)
    mix = spark.createDataFrame([("a", 0.3, 2), ("b", 0.4, 3), ("c", 0.2, 3), ("none", 0.05, 9), ("zero", None, None)], MIX)
    picked, report = mix_sources(docs, mix)
    out = {x.source: x for x in report.collect()}
    sizes = {}
    for x in token_counts(docs, "doc_id", "text", ["source"]).collect():
        sizes.setdefault(x.source, {})[x.doc_id] = x.tokens
    whole = sum(sum(sizes[s].values()) for s in "abc")
    copies = {}
    for x in picked.collect():
        assert x.doc_id not in copies.setdefault(x.source, {})
        copies[x.source][x.doc_id] = x.copies
        assert x.tokens == sizes[x.source][x.doc_id]
    assert set(copies) == {"a", "b", "c"}
    for s, share, most in (("a", 0.3, 2), ("b", 0.4, 3), ("c", 0.2, 3)):
        assert out[s].budget == pytest.approx(share * whole)
        reached = sum(sizes[s][d] * k for d, k in copies[s].items())
        assert out[s].reached_tokens == reached
        assert max(copies[s].values()) <= most
        if out[s].short:
            assert reached == most * sum(sizes[s].values()) < out[s].budget
        else:
            assert abs(reached - out[s].budget) <= max(sizes[s].values())
    assert out["c"].short and out["none"].short and not out["zero"].short and out["none"].documents == 0
    assert math.isclose(sum(x.reached_share for x in out.values()), 1.0)


def test_smaller_budgets_are_nested(spark):
    docs = make(spark, 1500, 2)
    taken = []
    for share in (0.1, 0.2, 0.5):
        mix = spark.createDataFrame([("a", share, 1), ("b", 1 - share, 9)], MIX)
        taken.append({x.doc_id for x in mix_sources(docs, mix)[0].where("source = 'a'").collect()})
    assert taken[0] < taken[1] < taken[2]


def test_edges(spark):
    mix = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 0)], MIX)
    picked, report = mix_sources(spark.createDataFrame([], DOCS), mix)
    assert picked.count() == 0 and {x.short for x in report.collect()} == {False}
    one = spark.createDataFrame([(1, "x y z", "a", "", 1, ""), (1, "x y z", "a", "", 1, "")], DOCS)
    picked, report = mix_sources(one, mix)
    assert [x.copies for x in picked.collect()] in ([1, 1], []) and report.count() == 2
    picked, report = mix_sources(make(spark, 50), spark.createDataFrame([], MIX))
    assert picked.count() == 0 and report.count() == 0

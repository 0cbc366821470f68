"""Top N of every group, light, heavy and mixed, against brute force."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lemmary.llm.topn import MOST_ROWS, heavy_groups, top_n

SCHEMA = "g string, h int, score double, name string, rank int, __id string, __n int"


def brute(rows, n):
    groups = defaultdict(list)
    for r in rows:
        groups[r[0], r[1]].append(r)
    out = []
    for g in groups.values():
        g.sort(key=lambda r: (-(r[2] if r[2] is not None else float("-inf")), r[3] is not None, r[3] or ""))
        out += [(*r[:4], i + 1) for i, r in enumerate(g[:n])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("heavy_rows", [0, 200, None, 10**9])
@pytest.mark.parametrize("n", [0, 3, 50])
def test_against_brute_force(spark, heavy_rows, n):
    rng = random.Random(n)
    rows = []
    for i in range(3000):
        g = rng.choice(["hot"] * 10 + ["warm"] * 4 + [None, "", *[f"g{j}" for j in range(40)]])
        rows.append((g, rng.choice([1, None]), rng.choice([1.0, 1.0, 0.5, None, rng.random()]), rng.choice([f"n{i}", f"n{i}", None, ""]), 9, "clash", 3))
    rows += rows[:100]
    got = top_n(spark.createDataFrame(rows, SCHEMA), ["g", "h"], [F.desc_nulls_last("score"), F.asc_nulls_first("name")], n, heavy_rows=heavy_rows)
    assert got.columns == ["g", "h", "score", "name", "__id", "__n", "rank"]
    assert sorted(((x.g, x.h, x.score, x.name, x["rank"]) for x in got.collect()), key=repr) == brute(rows, n)


def test_empty(spark):
    assert top_n(spark.createDataFrame([], SCHEMA), ["g"], [F.desc("score")], 3).count() == 0


def test_what_is_heavy(spark):
    few = [("hot", 5_000), *((f"g{i}", 2) for i in range(2_000))]
    sizes = lambda rows: spark.createDataFrame(rows, "g string, n bigint")
    heavy = lambda rows, *a: sorted(x.g for x in heavy_groups(sizes(rows), "n", *a).collect())
    assert heavy(few) == ["hot"] and heavy(few, 10_000) == [] and len(heavy(few, 1)) == 2_001
    # groups of one size are not skewed, but one alone may be too much for a task
    assert heavy([("a", 9_000), ("b", 9_000)]) == [] and heavy([("a", 2 * MOST_ROWS), ("b", 2 * MOST_ROWS)]) == ["a", "b"]
    assert heavy([]) == []


def test_columns_that_cannot_be_hashed(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("g"), "id", F.create_map(F.lit("k"), F.col("id")).alias("m"))
    got = top_n(df, ["g"], [F.desc("id")], 3, heavy_rows=10)
    assert sorted((x.g, x.id, x.m["k"], x["rank"]) for x in got.collect()) == [(0, 494, 494, 3), (0, 496, 496, 2), (0, 498, 498, 1), (1, 495, 495, 3), (1, 497, 497, 2), (1, 499, 499, 1)]


def test_one_group_of_equal_rows(spark):
    df = spark.range(3000).select(F.lit("a").alias("g"), F.lit(1.0).alias("s"))
    assert sorted(x["rank"] for x in top_n(df, ["g"], [F.desc("s")], 5, heavy_rows=100).collect()) == [1, 2, 3, 4, 5]

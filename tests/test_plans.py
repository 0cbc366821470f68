"""What the optimiser is expected to do with the operators' plans."""

import pytest
from pyspark.sql import functions as F

from lemmary.operators.grouped_join import join_stats
from lemmary.operators.relations import extract_triples
from lemmary.operators.store import postings
from lemmary.runtime import is_small, shared_dir
from lemmary.sources.logical_form import parse_sentences
from lemmary.sources.recovering_reader import parse_triples
from lemmary.sources.tables import table


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_extraction_needs_no_exchange(spark, tmp_path):
    parse_sentences(spark.createDataFrame([("f", 0, "t", "[1]:a-nn(e1,x1) & [2]:b-adj(e2,x1)")], "file string, sid bigint, raw_text string, line string")).write.parquet(str(tmp_path / "p"))
    found = extract_triples(spark.read.parquet(str(tmp_path / "p")))
    assert "Exchange" not in plan(found) and "Python" not in plan(found)


def test_scans_read_what_they_need(spark, base):
    parsed = parse_triples(table(spark, base, "triple_csv"), "line_id", "line")
    assert "ReadSchema: struct<line_id:bigint,line:string>" in plan(parsed) and "Exchange" not in plan(parsed)


def test_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, "nn", ["a"], 9)], "tid bigint, rel string, args array<string>, freq bigint").write.parquet(str(tmp_path / "s"))
    store = spark.read.parquet(str(tmp_path / "s"))
    shown = plan(postings(store.where((F.col("rel") == "nn") & (F.col("freq") > 5))))
    assert "EqualTo(rel,nn)" in shown and "GreaterThan(freq,5)" in shown


def test_heavy_keys_stay_in_place(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(900)] + [(f"k{i % 300}", i) for i in range(300)] + [(None, 1)], "key string, v int")
    stats = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    got = join_stats(rows, stats, ["key"], "n", 1201, max_small=0)
    want = rows.join(stats, "key")
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    light = join_stats(rows, stats.where("n > 5"), ["key"], "n", 10**9, max_small=0)  # nothing is heavy
    assert light.count() == 900
    few = join_stats(rows, stats, ["key"], "n", 1201)
    assert sorted(map(tuple, few.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert "BroadcastHashJoin" in plan(few)


def test_what_may_be_broadcast(spark):
    assert is_small(spark.range(10), 10) and not is_small(spark.range(11), 10)
    wide = spark.createDataFrame([("x" * 1000, [1] * 9, b"y", None)] * 3, "a string, b array<int>, c binary, d string")
    assert is_small(wide, 10) and not is_small(wide, 10, 3000)
    assert is_small(wide.limit(0), 0)


def test_a_cluster_must_name_its_shared_folder(spark):
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getConf():
            return {}

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session)

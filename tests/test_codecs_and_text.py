"""Codecs, text functions, topics and small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from lemmary.functions.codecs import decode_postings, decode_uint, delta_decode, delta_encode, encode_postings, encode_uint, update_postings
from lemmary.functions.terms import canonical_term, encode
from lemmary.functions.text import has_words, transliterate
from lemmary.operators.topics import filter_similar, fit_topics, topic_similarity
from lemmary.sources.resources import domain_pairs, multiword, read_concept_pairs, read_encoded, read_queries, read_stop_terms, read_terms, stop_terms, targets


def test_base_52(spark):
    values = [0, 1, 51, 52, 53, 2703, 2704, 10**9, 2**63 - 1, None]
    got = spark.createDataFrame([(v,) for v in values], "v bigint").withColumn("c", encode_uint(F.col("v"))).withColumn("d", decode_uint(F.col("c"))).collect()
    assert [x.c for x in got][:5] == ["a", "b", "Z", "ba", "bb"]
    assert [x.d for x in got] == values


@pytest.mark.parametrize("size", [0, 1, 10, 1000])
def test_postings_round_trip(spark, size):
    rng = random.Random(size)
    plist = sorted((rng.randrange(10**12), rng.randrange(5)) for _ in range(size))
    df = spark.createDataFrame([(plist[: size // 2], plist[size // 2 :], plist)], "a array<struct<tid: bigint, pos: int>>, b array<struct<tid: bigint, pos: int>>, w array<struct<tid: bigint, pos: int>>")
    got = df.select(
        decode_postings(encode_postings(F.col("w"))).alias("back"),
        decode_postings(update_postings(encode_postings(F.col("a")), F.col("b"))).alias("grown"),
        delta_decode(delta_encode(F.transform("w", lambda p: p["tid"]))).alias("tids"),
    ).first()
    assert [tuple(x) for x in got.back] == plist == [tuple(x) for x in got.grown]
    assert got.tids == [t for t, _ in plist]


def test_terms():
    import pyarrow as pa

    assert [canonical_term(x) for x in (None, " <NONE>", "<->", "None-<NONE-POS>", "", "ABC", " Й-A-NN ", "-NN")] == [None, None, None, None, "", "abc", "й-a-NN", "-NN"]
    codes, names = encode(pa.array(["b", None, "A", "a", "<->"]))
    assert codes.tolist() == [1, -1, 0, 0, -1] and names == ["a", "b"]
    assert encode(pa.chunked_array([], pa.string()))[1] == []


def test_text(spark):
    df = spark.createDataFrame([("Щука Яма съел",), (None,)], "t string")
    assert [x[0] for x in df.select(transliterate(F.col("t"))).collect()] == ["Shchuka Iama sel", None]
    df = spark.createDataFrame([("one two three",)], "t string")
    assert tuple(df.select(has_words(F.col("t"), ["one", "three"]), has_words(F.col("t"), ["thre"]), has_words(F.col("t"), [])).first()) == (True, False, True)
    assert spark.createDataFrame([("b  a&&b",)], "t string").select(multiword(F.col("t"))).first()[0] == "a&&b"


def test_topics(spark):
    docs = spark.createDataFrame([(["a", "b"] * 5,), (["c", "d"] * 5,)] * 10, "w array<string>")
    topics = fit_topics(docs, "w", topics=2, iterations=5)
    assert {x.term for x in topics.collect()} == set("abcd")
    fixed = spark.createDataFrame([("a", [2.0, 0.0]), ("b", [1.0, 1.0]), ("z", [0.0, 3.0])], "term string, weights array<double>")
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", "z"), ("a", "none")], "target string, source string")
    assert {x.source: x.similarity for x in topic_similarity(pairs, fixed).collect()} == {"a": 1.0, "b": 0.5, "z": 0.0, "none": -1.0}
    assert {x.source for x in filter_similar(pairs, fixed).collect()} == {"a", "b"}


def test_small_inputs(spark, tmp_path):
    def put(name, text, charset="utf-8"):
        (tmp_path / name).write_text(text, encoding=charset)
        return str(tmp_path / name)

    query = read_queries(spark, put("q.json", '{"query": [{"label": "l", "source": ["a", "b"], "target": ["x y"]}]}'))
    assert {tuple(x) for x in domain_pairs(query).collect()} == {("l", "a", "x y"), ("l", "b", "x y")}
    assert [tuple(x) for x in targets(query).collect()] == [("l", "x&&y")]
    assert {x.term for x in read_stop_terms(spark, put("s.csv", "1,900,a,NN\n2,600,b,NN\n3,400,c,NN\n4,700,d,NN\n")).collect()} == {"a", "b"}
    assert stop_terms(spark.createDataFrame([], "rank int, freq double, lemma string, pos string")).count() == 0
    assert [tuple(x) for x in read_concept_pairs(spark, put("c.csv", "Synonym;a;b/n\nDerivedFrom;c;d\nIsA;e;f\n"), "s").collect()] == [("a", "b")]
    assert [x.target for x in read_terms(spark, put("t.txt", "ab\n\nc\nде\n")).collect()] == ["ab", "де"]
    put("u.txt", "ёж\n", "utf-16")
    assert read_encoded(spark, str(tmp_path), "u.txt", charset="UTF-16").first().text == "ёж\n"

"""Triple store, source and pattern ranking on hand-made triples."""

import pytest
from pyspark.sql import functions as F

from lemmary.operators.patterns import dense_rows, find_patterns, pattern_line, pattern_matrix, top_patterns
from lemmary.operators.search import search_triples, siblings
from lemmary.operators.sources import find_sources, source_line, source_matrix
from lemmary.operators.store import StopTerms, build_store, counted_triples, dictionary, is_light, parse_row, postings
from lemmary.sources.resources import concept_pairs

TRIPLES = [
    (1, "subj_verb_dirobj", ["poverty", "kill", "man"], 10),
    (2, "subj_verb_dirobj", ["disease", "kill", "man"], 30),
    (3, "subj_verb_dirobj", ["war", "kill", "man"], 20),
    (4, "noun_adj", ["poverty", "deep"], 8),
    (5, "noun_adj", ["lake", "deep"], 40),
    (6, "noun_adj", ["disease", "deep"], 7),
    (7, "subj_verb", ["disease", "spread"], 13),
]
SCHEMA = "tid bigint, rel string, args array<string>, freq bigint"


@pytest.fixture(scope="module")
def store(spark):
    return spark.createDataFrame(TRIPLES, SCHEMA)


@pytest.fixture(scope="module")
def poverty(spark):
    return spark.createDataFrame([("poverty",)], "target string")


def ranked(df):
    return [(x["rank"], x.source, round(x.norm_source, 8), round(x.norm_target, 8), x.n, x.src_freq, x.tgt_freq) for x in df.orderBy("rank").collect()]


def test_sources(store, poverty):
    assert ranked(find_sources(store, poverty)) == [
        (1, "disease", 0.50462963, 0.27314815, 2, 37, 18),
        (2, "lake", 0.45977011, 0.09195402, 1, 40, 8),
        (3, "war", 0.28571429, 0.14285714, 1, 20, 10),
    ]
    assert [r[-1] for r in ranked(find_sources(store, poverty, minus_one=True))] == [17, 7, 9]
    assert len(ranked(find_sources(store, poverty, k=1))) == 1 and len(ranked(find_sources(store, poverty, k=0))) == 3


def test_stop_terms_and_concepts(spark, store, poverty):
    stop = spark.createDataFrame([("deep",)], "term string")
    assert [r[1:3] for r in ranked(find_sources(store, poverty, stop))] == [("disease", 0.375), ("war", 0.28571429)]
    cnet = concept_pairs(spark.createDataFrame([("Synonym;war;poverty",), ("Unknown;lake;poverty",), ("bad",)], "value string"))
    assert [r[1] for r in ranked(find_sources(store, poverty, None, cnet))] == ["disease", "lake"]


def test_wildcards_and_empty_slots(spark, poverty):
    """An empty slot of the target's triple matches anything; siblings without the
    key word count for the mass only."""
    rows = [(1, "subj_verb_prep_compl", ["poverty", "come", None, "man"], 10), (2, "subj_verb_prep_compl", ["war", "come", "to", "man"], 20), (3, "subj_verb_prep_compl", [None, "come", "x", "man"], 30), (4, "subj_verb_prep_compl", ["war", "go", "to", "man"], 99)]
    got = ranked(find_sources(spark.createDataFrame(rows, SCHEMA), poverty))
    assert got == [(1, "war", round(20 / 70, 8), round(10 / 70, 8), 1, 20, 10)]


def test_patterns(store, poverty):
    found = find_patterns(store, poverty)
    got = {x.pattern: (x["rank"], x.freq, round(x.norm_freq, 8), [(t.term, t.freq, t.n, round(t.norm, 8)) for t in x.terms]) for x in found.collect()}
    assert got == {
        "{subj_verb_dirobj;NN;kill;man}": (1, 10, 0.16666667, [("disease", 30, 3, 0.6)]),
        "{noun_adj;NN;deep}": (2, 8, 0.14545455, [("disease", 7, 3, 0.14)]),
    }
    assert top_patterns(found, 1, 0).count() == 1 and top_patterns(found, 0, 0).count() == 2
    cells = pattern_matrix(found)
    assert sorted((x.row_id, x.col_id, x.col_term, round(x.value, 2)) for x in cells.collect()) == [(0, 0, "disease", 0.6), (1, 0, "disease", 0.14)]
    assert [x.line for x in dense_rows(cells).orderBy("row_id").collect()] == ["0.6000000000000000 ", "0.1400000000000000 "]
    assert pattern_line(found, 1).count() == 2 and pattern_line(found).count() == 0


def test_source_matrix_and_lines(store, poverty):
    best = find_sources(store, poverty)
    cells = {(x.row_id, x.source, x.pattern) for x in source_matrix(best).collect()}
    assert cells == {(0, "disease", "{subj_verb_dirobj;NN;kill;man}"), (0, "disease", "{noun_adj;NN;deep}"), (1, "lake", "{noun_adj;NN;deep}"), (2, "war", "{subj_verb_dirobj;NN;kill;man}")}
    line = source_line(best).where("rank = 2").first().line
    assert line == "lake\t0.45977011\t0.09195402\t1\t40\t8\t{lake;deep;0.459770} "


def test_light(spark):
    rows = [("noun_adj", ["a", "b"]), ("noun_adj", [None, "b"]), ("noun_prep_noun", ["a", "in", None]), ("noun_prep_noun", ["a", "in", "c"]), ("noun_adj", ["a", "stop"])]
    stop = StopTerms(spark.createDataFrame([("stop",), (None,)], "term string"))
    got = [x.light for x in spark.createDataFrame(rows, "rel string, args array<string>").select(is_light(F.col("args"), F.col("rel"), stop).alias("light")).collect()]
    assert got == [False, True, True, False, True]


def test_parse_row(spark):
    lines = ["noun_verb_adv, <NONE>, быть-VB, можно-RB, <->, <->, 156", "nn, плей-офф-NN, билет&&вид-NN, <->, <->, <->, 7", "subj_verb_prep_compl, a-NN, b-VB, None-<NONE-POS>, c-NN, <->, 9"]
    got = [tuple(x.t) for x in spark.createDataFrame([(x,) for x in lines], "l string").select(parse_row(F.col("l")).alias("t")).collect()]
    assert got == [("noun_verb_adv", [None, "быть", "можно"], 156), ("nn", ["плей-офф", "билет&&вид"], 7), ("subj_verb_prep_compl", ["a", "b", None, "c"], 9)]


def test_store_and_search(spark, store):
    raw = spark.createDataFrame([(1, "nn", ["a", "b"], 3), (1, "nn", ["a", "b"], 3), (2, "nn", ["a", "b"], 3), (3, "nn", ["c", None], None)], SCHEMA)
    counted = counted_triples(raw)
    assert sorted((x.tid, x.freq) for x in counted.collect()) == [(1, 6), (3, 0)]
    assert build_store(counted).count() == 1 and build_store(counted, 6).count() == 0
    assert {x.term for x in dictionary(counted).collect()} == {"a", "b", "c"}
    assert postings(store).count() == 17
    terms = dictionary(store)
    assert search_triples(store, terms, [("disease", 0), ("nobody", None)]).count() == 3
    assert search_triples(store, terms, [("nobody", None)]).count() == 0
    assert search_triples(store, terms, [("disease", None)], "subj_verb").count() == 1
    both = siblings(store, spark.createDataFrame([("war",), ("disease",)], "target string"))
    pairs = {(x.target, x.sibling) for x in both.collect()}
    assert ("war", "disease") in pairs and ("disease", "war") in pairs

"""Logical forms: reading, relations, search and connection on small sentences."""

import pytest
from pyspark.sql import functions as F

from lemmary.operators.metaphor import find_connected, find_mentions
from lemmary.operators.relations import ACTIVE, INACTIVE, extract_relation, extract_triples, fold_triples
from lemmary.operators.search import search_sentences, sentence_postings
from lemmary.sources.logical_form import lines_of_files, lines_of_texts, parse_sentences, predicates, scan_sentences


def parse(spark, *lines):
    df = spark.createDataFrame([("f", "\n".join(lines))], "file string, text string")
    return parse_sentences(scan_sentences(lines_of_texts(df, "file", "text")))


def triples(spark, line, rel=None):
    found = extract_triples(parse(spark, line)) if rel is None else extract_relation(parse(spark, line), rel)
    return sorted((x.rel, *[a for a in x[3:] if a != "<->"]) for x in found.collect())


def test_reader(spark):
    got = parse(spark, "%%% first", "% second", "id(1).", "[1]:a:b-c-nn(e1,x1,u1,)", "[2]:x-cnj(e1) & of-in(e4,x1) & [3]:-nn(e1) & junk & [4]:v-v((e1,x1))", "7 skipped", "", "%  third", "[5]:d-a(e1,x1)")
    rows = got.orderBy("sid").collect()
    assert [(x.sid, x.raw_text, len(x.preds)) for x in rows] == [(0, "second", 1), (1, "second", 2), (2, " third", 1)]
    p = [tuple(x) for x in predicates(got).orderBy("sid", "ppos").select("pid", "lemma", "pos", "extra", "args").collect()]
    assert p[0] == ("[1]", "ab-c", "NN", None, ["e1", "x1", None, None])
    assert p[1] == (None, None, None, "of-in", ["e4", "x1"])
    assert p[2] == ("[4]", "v", "VB", None, ["e1", "x1"]) and p[3][2] == "ADJ"


def test_empty_and_very_long(spark):
    assert parse(spark, "").count() == 0 and parse(spark, "% only text").count() == 0
    long = " & ".join(f"[{i}]:w{i}-nn(e{i},x{i})" for i in range(3000))
    assert predicates(parse(spark, long)).count() == 3000


def test_files_keep_line_order(spark, tmp_path):
    (tmp_path / "a.lf").write_text("% t\n[1]:a-nn(e1,x1)\n[2]:b-nn(e2,x2)\n", encoding="utf-8")
    (tmp_path / "b.txt").write_text("[3]:c-nn(e1,x1)\n", encoding="utf-8")
    lines = lines_of_files(spark, str(tmp_path), "*.lf")
    assert [(x.sid, x.raw_text) for x in scan_sentences(lines).orderBy("sid").collect()] == [(0, "t"), (1, "t")]


CASES = {
    "subj_verb_dirobj": ("[1]:s-nn(e1,x1) & [2]:v-vb(e2,x1,x3) & [3]:o-nn(e3,x3)", ["s-NN", "v-VB", "o-NN"]),
    "subj_verb_indirobj": ("[2]:v-vb(e2,u1,u2,x3) & [3]:o-nn(e3,x3) & [4]:p-nn(e4,x3)", ["<NONE>", "v-VB", "o&&p-NN"]),
    "subj_verb_instr": ("[2]:v-vb(e2,u1) & instr(e9,e2,x3) & [3]:o-nn(e3,x3)", ["<NONE>", "v-VB", "o-NN"]),
    "subj_verb": ("[1]:s-nn(e1,x1) & [2]:v-vb(e2,x1,u1)", ["s-NN", "v-VB"]),
    "subj_verb_prep_compl": ("[2]:v-vb(e2,x1) & of(e3,e2,x3) & [3]:o-nn(e3,x3)", ["<NONE>", "v-VB", "None-<NONE-POS>", "o-NN"]),
    "subj_verb_verb_prep_noun": ("[2]:v-vb(e2,x1,e3) & [3]:w-vb(e3) & [4]:in-in(e4,e3,x5) & [5]:o-nn(e5,x5) & [6]:at-in(e6,e3,x7) & [7]:n-nn(e7,x7)", None),
    "subj_verb_verb": ("[1]:s-nn(e1,x1) & [2]:v-vb(e2,x1,e3) & [3]:w-vb(e3)", ["s-NN", "v-VB", "w-VB"]),
    "noun_adj": ("[1]:s-nn(e1,x1) & [2]:a-adj(e2,x1)", ["s-NN", "a-ADJ"]),
    "noun_verb_adv": ("[2]:v-vb(e2,x1) & [3]:r-rb(e3,e2)", ["<NONE>", "v-VB", "r-RB"]),
    "noun_equal_prep_noun": ("[1]:s-nn(e1,x1) & [2]:o-nn(e2,x2) & equal(e9,x1,x2) & [3]:of-in(e3,x2,x4) & [4]:h-nn(e4,x4)", ["s-NN", "o-NN", "of-PREP", "h-NN"]),
    "nn": ("[1]:s-nn(e1,x1) & [2]:o-nn(e2,x1)", ["s-NN", "o-NN"]),
    "nnn": ("[1]:a-nn(e1,x1) & [2]:b-nn(e2,x1) & [3]:c-nn(e3,x1)", ["a-NN", "b-NN", "c-NN"]),
    "noun_equal_noun": ("[1]:s-nn(e1,x1) & [2]:o-nn(e2,x2) & equal(e9,x1,x2)", ["s-NN", "o-NN"]),
    "noun_prep_noun": ("[1]:s-nn(e1,x1) & [2]:of-in(e2,x1,x3) & [3]:o-nn(e3,x3)", ["s-NN", "of-PREP", "o-NN"]),
    "compl": ("[1]:s-nn(e1,x1) & [2]:v-vb(e2,u1) & compl(e9,x1,e2)", ["s-NN", "v-VB"]),
    "nn_prep": ("[1]:s-nn(e1,x1) & [2]:of-in(e2,x1,x3) & [3]:o-nn(e3,x3)", ["s-NN", "of-PREP", "o-NN"]),
    "noun_adj_prep_noun": ("[1]:s-nn(e1,x1) & [2]:a-adj(e2,x1) & [3]:of-in(e3,x8,x4) & [4]:o-nn(e4,x4)", ["s-NN", "a-ADJ", "of-PREP", "o-NN"]),
}


@pytest.mark.parametrize("rel", [*ACTIVE, *INACTIVE])
def test_relation(spark, rel):
    line, want = CASES[rel]
    got = triples(spark, line, rel)
    if rel == "subj_verb_verb_prep_noun":  # the first pair emits for both of its prepositions
        assert got == [(rel, "<NONE>", "v-VB", "w-VB", "at-PREP", "n-NN"), (rel, "<NONE>", "v-VB", "w-VB", "in-PREP", "o-NN")]
    else:
        assert got == [(rel, *want)]


def test_blocked_relations(spark):
    prep = " & [8]:of-in(e8,x1,x9)"
    for rel in ("noun_adj", "nn", "nnn"):
        assert triples(spark, CASES[rel][0] + prep, rel) == []
    assert triples(spark, CASES["noun_equal_noun"][0] + " & [8]:of-in(e8,x2,x9)", "noun_equal_noun") == []
    assert triples(spark, CASES["subj_verb"][0].replace("u1", "x7"), "subj_verb") == []
    assert triples(spark, CASES["noun_verb_adv"][0] + " & [8]:of-in(e8,e3,x9)", "noun_verb_adv") == []
    five = " & ".join(f"[{i}]:n{i}-nn(e{i},x1)" for i in range(5)) + " & [9]:a-adj(e9,x1)"
    assert triples(spark, five, "noun_adj") == []  # sets of more than four are none


def test_one_lemma_is_one_word(spark):
    """A word hooks where its lemma does, and pairs of lemmas count once."""
    line = "[1]:s-nn(e1,x1) & [2]:s-nn(e2,x2) & [3]:of-in(e3,x1,x3) & [4]:o-nn(e4,x3) & [5]:of-in(e5,x3,x1)"
    assert triples(spark, line, "noun_prep_noun") == [("noun_prep_noun", "s-NN", "of-PREP", "o-NN")]


def test_greedy_pairs(spark):
    """Three nouns equal to one another: used pairs are not used again."""
    line = CASES["noun_equal_prep_noun"][0] + " & equal(e10,x1,x2) & [5]:at-in(e5,x2,x4)"
    assert triples(spark, line, "noun_equal_prep_noun") == [("noun_equal_prep_noun", "s-NN", "o-NN", "of-PREP", "h-NN")]


def test_fold_and_extension(spark):
    p = parse(spark, *[CASES["nn"][0]] * 3)
    assert [(x.rel, x.freq) for x in fold_triples(extract_triples(p)).collect()] == [("nn", 3)]
    own = {"first": lambda preds: F.array(F.array(F.get(preds, F.lit(0))["lemma"]))}
    assert [x.arg1 for x in extract_triples(p, own).collect()] == ["s"] * 3
    with pytest.raises(ValueError, match="no relation"):
        extract_triples(p, {})


def test_connection(spark):
    p = parse(spark, "% text", "[1]:a-nn(e1,x1) & [2]:b-vb(e2,x1,u1) & [3]:c-nn(e3,x2) & of-in(e4,x1,x2) & [4]:d-vb(e5,x9,u2) & [5]:e-nn(u9)")
    pairs = spark.createDataFrame([("l", "a", t) for t in "bcdex"] + [("l", "a b", "c"), ("l", "a x", "c")], "label string, source string, target string")
    got = sorted((x.source, x.target) for x in find_connected(p, pairs).collect())
    assert got == [("a", "b"), ("a", "c"), ("a b", "c")]
    assert [(x.source, x.target) for x in find_mentions(p, pairs).collect()] == [("a", "b")]


def test_sentence_search(spark):
    index = sentence_postings(parse(spark, "[1]:a-nn(e1) & [2]:b-nn(e2)", "[1]:a-nn(e1)", "[1]:c-nn(e1)"))
    rows = lambda *a: sorted(x.sid for x in search_sentences(index, *a).collect())
    assert rows([["a"], ["b", "c"]]) == [0, 0, 1, 2] and rows([["a"], ["b", "c"]], "and") == [0] and rows([]) == []

"""The recovering reader: one line, many lines, and whole columns."""

import pytest

from lemmary.plans.loading import p2_texts
from lemmary.sources.recovering_reader import TripleGrammar, parse_triples, sound_triples, unsound_lines

GOOD = "noun_adj, a-NN, b-ADJ, <->, <->, <->, 7"


def one(line):
    found = list(TripleGrammar().parse(line))
    assert len(found) == 1
    return found[0]


@pytest.mark.parametrize(
    ("line", "fields", "freq"),
    [
        (GOOD, ["noun_adj", "a-NN", "b-ADJ", "<->", "<->", "<->"], 7),
        (GOOD + "\r", ["noun_adj", "a-NN", "b-ADJ", "<->", "<->", "<->"], 7),
        ('nn, "a, b-NN", c&&d-NN, <->, <->, <->, "007"', ["nn", "a, b-NN", "c&&d-NN", "<->", "<->", "<->"], 7),
        ('"nn", """q"" x-NN", <NONE>, None-<NONE-POS>, <->, <->, 9223372036854775807', ["nn", '"q" x-NN', "<NONE>", "None-<NONE-POS>", "<->", "<->"], 2**63 - 1),
        ("nn, плей-офф o'x 5-NN, a,b-NN, <->, <->, <->, 1", ["nn", "плей-офф o'x 5-NN", "a,b-NN", "<->", "<->", "<->"], 1),
    ],
)
def test_sound(line, fields, freq):
    f = one(line)
    assert (f.fields, f.freq, f.reason) == (fields, freq, None)


@pytest.mark.parametrize(
    ("line", "reason", "where", "column"),
    [
        (None, "columns", "line", 1),
        ("", "columns", "line", 1),
        ("nn,a-NN,b-NN,<->,<->,<->,1", "columns", "line", 1),
        (GOOD + ", 3", "columns", "line", 1),
        ('nn, "a-NN, b-NN, <->, <->, <->, 1', "quoting", "arg1", 5),
        ('nn, a"-NN, b-NN', "quoting", "arg1", 5),
        ('nn, "a"-NN, b-NN, <->, <->, <->, 1', "quoting", "arg1", 5),
        ('nn, a-NN, <->"", <->, <->, <->, 1', "quoting", "arg2", 11),
        (GOOD.replace("noun_adj", "noun-adj"), "value", "rel", 1),
        (GOOD.replace("a-NN", "-NN"), "value", "arg1", 11),
        (GOOD.replace("a-NN", "a-Nn"), "value", "arg1", 11),
        (GOOD.replace("a-NN", " a-NN"), "value", "arg1", 11),
        (GOOD.replace("a-NN", "a\x07b-NN"), "value", "arg1", 11),
        (GOOD.replace("a-NN", "a�-NN"), "value", "arg1", 11),
        (GOOD.replace("a-NN", "a\nb-NN"), "value", "arg1", 11),
        (GOOD[:-1], "value", "freq", 39),
        (GOOD[:-1] + "0", "value", "freq", 39),
        (GOOD[:-1] + "٣", "value", "freq", 39),
        (GOOD[:-1] + "1.0", "value", "freq", 39),
        (GOOD[:-1] + str(2**63), "value", "freq", 39),
        (GOOD + "\r\r", "value", "freq", 39),
    ],
)
def test_unsound(line, reason, where, column):
    f = one(line)
    assert (f.fields, f.reason, f.where, f.column) == (None, reason, where, column)


def test_very_long():
    assert one(GOOD.replace("a-NN", "a" * 1_000_000 + "-NN")).freq == 7
    assert one('nn, "' + "a, " * 300_000).reason == "quoting"
    assert one("9" * 100_000).reason == "columns"


def test_many_lines_resume_at_record_starts():
    text = "\n".join([GOOD, 'nn, "open-NN, b-NN, <->, <->, <->, 1', GOOD, "junk", 'nn, "two\nlines-NN", b-NN, <->, <->, <->, 2', 'nn, "a"x, b', "noise", GOOD])
    found = [(f.line, f.reason, f.freq) for f in TripleGrammar(many=True).parse(text)]
    assert found == [(1, None, 7), (2, "quoting", None), (3, None, 7), (4, "columns", None), (5, "value", None), (7, "quoting", None), (9, None, 7)]
    assert [f.reason for f in TripleGrammar(many=True).parse('x"\n' * 3)] == ["quoting"]


def test_resuming_needs_a_validated_start():
    """Junk after a broken record, also junk that begins like a record, belongs to it."""
    text = "\n".join(['nn, a"-NN, b-NN', "junk one", "nn, junk two, x", 'nn, "open', GOOD, "nn, a-NN, 3"])
    found = [(f.line, f.reason, f.where, f.column) for f in TripleGrammar(many=True).parse(text)]
    assert found == [(1, "quoting", "arg1", 5), (5, None, None, None), (6, "columns", "line", 1)]
    inside = f'nn, "a quote that holds\n{GOOD}\nand goes on-NN", b-NN, <->, <->, <->, 2\n{GOOD}'
    assert [(f.line, f.reason) for f in TripleGrammar(many=True).parse(inside)] == [(1, "quoting"), (2, None), (3, "quoting"), (4, None)]
    later = f'{GOOD}\nnn, a-NN, "open, <->, <->, <->, 1\n{GOOD}'  # a sound start of its own, broken after it
    assert [(f.line, f.reason, f.where) for f in TripleGrammar(many=True).parse(later)] == [(1, None, None), (2, "quoting", "arg2"), (3, None, None)]
    harmless = 'nn, "two\nnn, lines", <->, <->, <->, <->, 2'
    assert [(f.line, f.reason, f.where) for f in TripleGrammar(many=True).parse(harmless)] == [(1, "value", "arg1")]


def test_files_as_texts(spark, tmp_path):
    lines = [GOOD, 'nn, "never closed-NN, x-NN, <->, <->, <->, 1', "junk", "more junk", GOOD, None, GOOD]
    rows = [(i, "f", i + 1, x) for i, x in enumerate(lines)] + [(100 + i, "g", 1 + 1000 * i, GOOD) for i in range(3)]
    spark.createDataFrame(rows, "line_id bigint, file string, line_no bigint, line string").write.parquet(f"{tmp_path}/triple_csv.parquet")
    got = sorted((x.file, x.block, x.line_in_text, x.reason) for x in p2_texts(spark, str(tmp_path)).collect())
    assert got == [("f", 0, 1, None), ("f", 0, 2, "quoting"), ("f", 0, 5, None), ("f", 0, 6, "columns"), ("f", 0, 7, None), ("g", 0, 1, None), ("g", 1, 1, None), ("g", 2, 1, None)]


def test_columns(spark):
    rows = [(1, GOOD, "clash"), (1, GOOD, "clash"), (2, "bad", None), (None, GOOD, None), (3, None, None)]
    df = spark.createDataFrame(rows, "line_id bigint, line string, reason string")
    parsed = parse_triples(df, "line_id", "line")
    assert sorted(str(x.line_id) for x in sound_triples(parsed).collect()) == ["1", "1", "None"]
    assert sorted((x.line_id, x.reason, x.field) for x in unsound_lines(parsed).collect()) == [(2, "columns", "line"), (3, "columns", "line")]
    assert parse_triples(df.limit(0), "line_id", "line").count() == 0
    whole = spark.createDataFrame([("f", GOOD + "\n" + GOOD + "\nx")], "file string, text string")
    assert [(x.line_in_text, x.reason) for x in parse_triples(whole, "file", "text", many=True).collect()] == [(1, None), (2, None), (3, "columns")]

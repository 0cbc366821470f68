"""Endings one by one, exposed limits, and whole runs."""

import random

import pytest

from lemmary.llm.truncation import UNITS, Habits, broken_off, measure, truncated_texts

HABITS = Habits({"— the desk", "#tag #other"}, {"approx", "no"}, {"would not"})

FULL = [
    "", None, "   ", "It ends.", "It ends!  ", "Does it?\n", 'He said: "Go."', "«Пусть так.»", "It ends. (And so on.)", "It ends. (END)", "It ends… (END)".replace("It", "It would not"),
    "It ends.\n— the desk", "It ends.\n***", "It ends.\n* * *\n#tag #other", "<p>It ends.</p>", "<p>It ends.</p>\n</div>", "They would not go…",
    "% Text.\nid(1).\n[1]:a-nn(e1,x1) & [2]:b-vb(e2,x1)", "% Text.\nid(1).", "% Text.", "[1]:a-nn(e1,x1) & of-in(e4,x1)\n", "(Whole remark.)", "It says &quot;Go.&quot;", "Ends in bold.**",
]
CUT = [
    ("It en", "sentence"), ("It ends,", "sentence"), ("The boat (a plain one)", "sentence"), ("The boat (a pl", "sentence"), ("«Мы станем»", "sentence"), ("It costs approx.", "abbreviation"),
    ("Under item No.", "abbreviation"), ("One thing is w…", "mark"), ("One thing is w...", "mark"), ("It en (END)", "sentence"), ("It en\n— the desk", "sentence"), ("<p>It en</p>", "sentence"),
    ("<p>It ends.</", "tag"), ("<p>It ends.</p>\n<di", "tag"), ("It is �", "character"), ("% Text.\nid(1", "predicate"), ("% Text.\nid(1).\n[1]:a-nn(e1,x1) &", "predicate"),
    ("% Text.\nid(1).\n[1]:a-nn(e1,x1) & [2]:b-v", "predicate"), ("% Text.\nid(1).\n[1]:a-nn(e1", "predicate"), ("% Some te", "sentence"), ("It ends.\n— the de", "sentence"),
]


@pytest.mark.parametrize("text", FULL)
def test_full_endings(text):
    assert broken_off(text, HABITS) is None


@pytest.mark.parametrize(("text", "why"), CUT)
def test_cut_endings(text, why):
    assert broken_off(text, HABITS) == why


def test_natural_ellipsis_at_a_limit():
    assert broken_off("They would not go…", HABITS, at_limit=True) == "mark"
    assert broken_off("They went.... ", HABITS, at_limit=True) is None and broken_off("They paid approx....", HABITS, at_limit=True) == "abbreviation"
    assert broken_off("Unknown habit here…", Habits(set(), set(), None)) is None


def test_units():
    text = 'ё<&>"\n\\😀'
    got = measure(text + "�")
    assert (got["chars"], got["utf8"], got["utf16"]) == (8, len(text.encode()), 9)
    import html
    import json

    assert got["entity_chars"] == len(html.escape(text, quote=False)) and got["entity_quote_chars"] == len(html.escape(text))
    assert got["json_chars"] == len(json.dumps(text, ensure_ascii=False)) - 2 and got["json_ascii"] == len(json.dumps(text)) - 2
    assert got["crlf_utf8"] == len(text.replace("\n", "\r\n").encode())
    assert measure("")["chars"] == 0 and tuple(got) == UNITS


SCHEMA = "doc_id int, text string, source string, unit string, size int, reason string"


def test_exposed_limits(spark):
    rng = random.Random(4)
    rows, cut, n = [], set(), 0
    sentence = lambda: " ".join(rng.choice(["лодка", "boat", "a & b", "wind", "x<y"]) for _ in range(rng.randrange(4, 9))).capitalize() + ".\n"
    limits = {"plain": None, "chars": ("chars", 400), "bytes": ("utf8", 500), "escaped": ("entity_chars", 450), "windows": ("crlf_chars", 380)}
    for source, limit in limits.items():
        for _ in range(400):
            text = "".join(sentence() for _ in range(rng.randrange(3, 25))).strip()
            whole = text
            while limit and measure(text)[limit[0]] > limit[1]:
                text = text[:-1]
            n += 1
            rows.append((n, text, source, "clash", 1, None))
            if text != whole and not text.rstrip().endswith("."):
                cut.add(n)
    rows += [(n + 1, None, "plain", "", 1, ""), (n + 2, "", None, "", 1, ""), (n + 3, "Whole. " * 30_000 + "en", None, "", 1, "")]
    cut.add(n + 3)
    found, sources = truncated_texts(spark.createDataFrame(rows, SCHEMA))
    assert {x.doc_id for x in found.collect()} == cut
    exposed = {x.source: (x.unit, x["size"]) for x in sources.collect()}
    assert exposed["plain"] == (None, None)
    for source, limit in limits.items():
        if limit:
            assert exposed[source] == limit
    assert {x.source: x.texts for x in sources.collect()}["plain"] == 401


def test_empty(spark):
    found, sources = truncated_texts(spark.createDataFrame([], SCHEMA))
    assert found.count() == 0 and sources.count() == 0


def test_all_limits_hold_without_source(spark):
    """Also the largest of more than a thousand."""
    rows = [(f"s{size}", "x" * (size - 1) + ".") for size in range(200, 1210) for _ in range(5)]
    rows += [(None, "x" * 1207 + " …"), (None, "x" * 1307 + " …")]
    df = spark.createDataFrame([(i, text, source) for i, (source, text) in enumerate(rows)], "doc_id int, text string, source string")
    found, _ = truncated_texts(df)
    assert [(x.doc_id, x.reason) for x in found.collect()] == [(5050, "mark")]


def test_long_remarks_and_tags():
    long = "a remark of many words " * 20
    assert broken_off(f"He left. ({long})", HABITS) is None and broken_off(f"He left. ({long}(with one in it))", HABITS) is None
    assert broken_off(f"He le ({long})", HABITS) == "sentence" and broken_off(f"({long})", HABITS) is None
    assert broken_off(f'He left. <a href="x" title="{long}Really.', HABITS) == "tag"
    assert broken_off(f"He left. <a {'b= c ' * 200}!", HABITS) is None  # in linear time


def test_long_closing_lines(spark):
    sign = "Sent by the desk of the morning paper to all who read it every day of the week"
    rows = [(i, f"Story {i} of the day ends.\n{sign}", "a") for i in range(6)] + [(9, f"Story of the ni\n{sign}", "a"), (10, "It ends.", "a")]
    found, _ = truncated_texts(spark.createDataFrame(rows, "doc_id int, text string, source string"))
    assert [(x.doc_id, x.reason) for x in found.collect()] == [(9, "sentence")]


def test_tags_and_words_of_any_length():
    for n in (20, 300, 5_000):
        assert broken_off(f'A full sentence. <a href="http://{"x" * n}.', HABITS) == "tag"
        assert broken_off(f'A full sentence. <a title="{"word " * (n // 5)}end.', HABITS) == "tag"
    assert broken_off("It costs " + "x" * 500 + ".", Habits(set(), {"x" * 500}, None)) == "abbreviation"
    assert broken_off(f"They would not {'x' * 400}…", HABITS) is None and broken_off(f"They could not {'x' * 400}…", HABITS) == "mark"


def test_quotations_of_any_length():
    long = "they went on and on, " * 50
    assert broken_off(f"«{long}he said.»", HABITS) is None and broken_off(f"«{long}he said»", HABITS) == "sentence"
    assert broken_off(f'He left. "{long}she said."', HABITS) is None and broken_off(f'He le "{long}she said.', HABITS) is None


def test_entities_are_read_anywhere():
    assert broken_off("He said: &quot;" + "so it is. " * 60 + '"', HABITS) is None


def test_endless_endings():
    """Remarks, quotations, closing lines and tags by the hundred thousand take linear time."""
    for piece in (" (a.)", " «a.»", "\n***", "</p>", ")", " <", "…", " "):
        broken_off("It ends." + piece * 100_000, HABITS)
        broken_off("It en" + piece * 100_000, HABITS)


def test_sources_that_write_without_marks(spark):
    """There a missing mark counts at the limit only."""
    rows = [(i, f"headline of the day number {i:04} and {'more ' * (i % 9)}".strip(), "titles") for i in range(200)]
    rows += [(1000 + i, ("headline of the long day " * 9)[:120], "titles") for i in range(100)]
    rows += [(2000 + i, f"Story {i} ends {'so ' * (i % 7)}well.", "prose") for i in range(200)] + [(3000, "Story of the ni", "prose")]
    found, sources = truncated_texts(spark.createDataFrame(rows, "doc_id int, text string, source string"))
    got = {(x.doc_id, x.reason, x.unit) for x in found.collect()}
    assert got == {(1000 + i, "sentence", "chars") for i in range(100)} | {(3000, "sentence", None)}
    assert {x.source: x.truncated for x in sources.collect()} == {"titles": 100, "prose": 1}

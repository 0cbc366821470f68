"""Leaked passages: rules on single pairs, and whole joins against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lemmary.llm import leakage
from lemmary.llm.leakage import _meet, _necessary, bloom, in_bloom, leaked_items, passage, words

ITEM = [f"w{i}" for i in range(60)]


def test_words():
    assert words("<p>Ёлка&nbsp;— «CAFÉ»,\n% co­op x_y</p>") == ["елка", "cafe", "coop", "x", "y"]
    assert words("") == [] and words("... <br/> !") == []


def check(doc):
    return passage(doc, ITEM, 5, 12, 8)


def test_passage_rules():
    assert check(["a", *ITEM[10:22], "b"]) == 12
    assert check(["a", *ITEM[10:21], "b"]) == 0  # 11 words
    replaced = [*ITEM[10:16], "other", *ITEM[17:22]]
    assert check(replaced) == 12  # one of 12 replaced
    assert check([*ITEM[10:16], *ITEM[17:22]]) == 12  # one left out
    assert check([*ITEM[10:16], "more", *ITEM[16:22]]) == 12  # one added
    twice = [*ITEM[10:15], "x", *ITEM[16:20], "y", *ITEM[21:26]]
    assert check(twice) == 16  # two of 16 replaced
    assert check(twice[:-1]) == 0  # two of 15
    assert check([]) == 0 and check(ITEM[:4]) == 0
    assert passage(ITEM, [], 5, 12, 8) == 0


def edits(doc, item):
    """Fewest edits that turn part of doc into all of item."""
    row = [0] * (len(doc) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(doc, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (w != d)))
        row = new
    return min(row)


def brute(doc, item):
    """Any run of 12 or more item words that starts and ends in an equal word."""
    fives = lambda ws: {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}
    if not fives(doc) & fives(item):  # so few edits leave five words in a row
        return False
    for a in range(len(item)):
        for b in range(a + 12, min(len(item), a + 40) + 1):
            if edits(doc, item[a:b]) * 8 <= b - a:
                trimmed = edits(doc, item[a + 1 : b]) == edits(doc, item[a:b]) - 1 or edits(doc, item[a : b - 1]) == edits(doc, item[a:b]) - 1
                if not trimmed:
                    return True
    return False


def test_join_against_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(120)]
    lead = "Read this and answer."
    items, docs = [], []
    for i in range(25):
        ws = [rng.choice(vocabulary) for _ in range(rng.choice([8, 20, 40]))]
        items.append((i, (lead + " " if i % 2 else "") + " ".join(ws) + ".", "en"))
    items += [(100, None, "en"), (101, "", "en"), (None, items[0][1], "en"), items[3]]
    for d in range(160):
        ws = [rng.choice(vocabulary) for _ in range(30)]
        if d % 2:
            source = rng.choice(items[:25])[1].removeprefix(lead).strip(" .").split()
            a = rng.randrange(max(1, len(source) - 12))
            part = source[a : a + rng.randrange(6, 26)]
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(part))
                part[at : at + 1] = rng.choice([["zz"], [], [part[at], "zz"]])
                part = part or ["zz"]
            ws[10:10] = [w.upper() + "," for w in part]
        docs.append((d, ("<p>" if d % 3 else lead + " ") + " ".join(ws), "x", 1))
    docs += [(900, None, "x", 1), (901, "", "x", 1), (902, lead * 50, "x", 1), (903, "y " * 200_000, "x", 1), docs[1]]
    df = spark.createDataFrame(docs, "doc_id int, text string, hash string, item int")
    it = spark.createDataFrame(items, "item_id int, text string, lang string")
    want = set()
    for d, text, *_ in docs:
        for i, item, _ in items:
            if text and item and i is not None and d != 903:
                body = words(item.removeprefix(lead))
                if len(body) >= 12 and brute(words(text), body):
                    want.add((d, i))
    assert len(want) > 20
    for memory in (2_000_000, 3):  # in memory, and through the shuffle
        got = leaked_items(df, it, memory_shingles=memory).collect()
        assert {(x.doc_id, x.item_id) for x in got} == want
        assert len(got) == len(want)


def test_empty(spark):
    docs, items = "doc_id int, text string", "item_id int, text string"
    some = spark.createDataFrame([(1, " ".join(ITEM))], docs)
    assert leaked_items(spark.createDataFrame([], docs), spark.createDataFrame([(1, " ".join(ITEM))], items)).count() == 0
    assert leaked_items(some, spark.createDataFrame([], items)).count() == 0
    assert leaked_items(some, spark.createDataFrame([(7, " ".join(ITEM))], items).withColumnRenamed("text", "t"), item_text="t").collect()[0].n_words == 60


def test_bloom_filter(spark):
    known = np.random.default_rng(1).integers(0, 2**64, 20_000, np.uint64)
    held = bloom(spark.createDataFrame(pa.table({"hash": known.view(np.int64)})))
    assert in_bloom(held, known).all()
    other = np.random.default_rng(2).integers(0, 2**64, 20_000, np.uint64)
    assert in_bloom(held, other).mean() < 0.01


@pytest.mark.parametrize("sent", [0, 10**6])
def test_hot_shingles(spark, monkeypatch, sent):
    """A join by hash in which one hash holds most rows, sent whole or split."""
    monkeypatch.setattr(leakage, "MOST_SENT", sent)
    hits = spark.createDataFrame([(i, 7 if i % 3 else i) for i in range(900)], "doc int, hash bigint")
    other = spark.createDataFrame([(1, 7), (2, 7), (3, 9), (4, 5)], "item int, hash bigint")
    rarity = hits.groupBy("hash").agg(F.count("*").alias("df"))
    got = sorted((x.doc, x.item) for x in _meet(hits, rarity, other).collect())
    assert got == sorted([(i, item) for i in range(900) if i % 3 for item in (1, 2)] + [(9, 3)])


def test_prefix_of_long_items():
    """Linear in the item's length, and every window keeps what it needs."""
    rng = random.Random(3)
    n = 3000
    t = pa.table({"item": [1] * n, "ipos": list(range(n)), "iwords": [n + 4] * n, "hash": list(range(n)), "df": [rng.randrange(100) for _ in range(n)]})
    kept = set(_necessary(5, 12, 8)(t).column("ipos").to_pylist())
    assert len(kept) < n
    for words_ in range(12, 24):
        size, most = words_ - 4, (words_ - 4) - 5 * (words_ // 8) - 1
        assert all(sum(i not in kept for i in range(a, a + size)) <= most for a in range(n - size + 1))

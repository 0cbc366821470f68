"""Record and occurrence counts against brute force; edge cases."""

import random
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa

from lemmary.functions.terms import canonical_term
from lemmary.llm import frequency
from lemmary.llm.frequency import BLOCK, _containers, _dense_union, _merge, term_counts, term_frequencies

SCHEMA = "tid bigint, arg1 string, arg2 string, freq bigint, df string, block int"


def brute(rows):
    seen, tids = {}, set()
    for tid, a, b, f, *_ in rows:
        if tid is None:
            continue
        tids.add(tid)
        for t in {canonical_term(a), canonical_term(b)} - {None}:
            old = seen.setdefault(t, {}).get(tid)
            seen[t][tid] = max(f or 0, old) if old is not None else (f or 0)
    return {t: (len(d), sum(d.values())) for t, d in seen.items()}, len(tids)


def test_against_brute_force(spark):
    rng = random.Random(5)
    words = ["a-NN", "A-NN", " a-NN", "b-VB", "b-NN", None, "<NONE>", "<->", "None-<NONE-POS>", "", "x", unicodedata.normalize("NFD", "ño-NN"), "ño-NN"]
    rows = []
    for i in range(4000):
        tid = rng.choice([rng.randrange(200), rng.randrange(-(10**12), 10**12), i, None if i % 97 == 0 else i])
        f = rng.choice([None, 0, 1, 5, 300, -70_000, 2**40])
        rows.append((tid, rng.choice(words), rng.choice([*words, f"w{i}-NN"]), f, "extra", 7))
    rows += rows[:500]
    got = {x.term: (x.df, x.total) for x in term_counts(spark.createDataFrame(rows, SCHEMA), "tid", ["arg1", "arg2"], "freq").collect()}
    want, records = brute(rows)
    assert got.pop(None)[0] == records
    assert got == want


def test_dense_containers(spark):
    """A term in every record, so bitmaps are used, over several blocks."""
    df = spark.range(200_000).selectExpr("id AS tid", "'hot-NN' AS arg1", "if(id % 2 = 0, 'half-NN', null) AS arg2", "1L AS freq")
    got = {x.term: (x.df, x.total) for x in term_counts(df.union(df), "tid", ["arg1", "arg2"], "freq").collect()}
    assert got == {None: (200_000, 0), "hot-NN": (200_000, 200_000), "half-NN": (100_000, 100_000)}


def test_marks_and_empty(spark):
    rows = [(i, "common-NN", f"r{i}-NN" if i < 3 else None, 1 if i else 6, None, None) for i in range(1000)]
    got = {x.term: x.mark for x in term_frequencies(spark.createDataFrame(rows, SCHEMA), "tid", ["arg1", "arg2"], "freq").collect()}
    assert got == {"common-NN": "common", "r0-NN": None, "r1-NN": "rare", "r2-NN": "rare"}
    assert term_frequencies(spark.createDataFrame([], SCHEMA), "tid", ["arg1", "arg2"], "freq").count() == 0


def test_long_term(spark):
    rows = [(1, "x" * 1_000_000, None, 1, None, None)]
    got = term_frequencies(spark.createDataFrame(rows, SCHEMA), "tid", ["arg1", "arg2"], "freq").collect()
    assert len(got) == 1 and len(got[0].term) == 1_000_000


def test_runs_are_merged_piece_by_piece(monkeypatch):
    """Containers of one (term, block) from many chunks, dense beside sparse, some
    delivered twice, in batches and pieces that cut runs anywhere."""
    monkeypatch.setattr(frequency, "ENTRIES", 5_000)
    parts = []
    for start, step in ((0, 1), (1, 3), (0, 7)):
        ids = np.arange(start, 140_000, step)
        code = np.concatenate([np.zeros(len(ids), int), 1 + ids % 50, np.full(len(ids), 51)])
        parts += _containers(code, np.tile(ids, 3), np.tile(ids % 300, 3), ["hot", *(f"w{j:02}" for j in range(50))])
    t = pa.Table.from_batches(parts).sort_by([("term", "ascending"), ("block", "ascending")])
    for size in (1, 7, 10_000):
        df, total = Counter(), Counter()
        for b in _merge(t.to_batches(max_chunksize=size)):
            for x in b.to_pylist():
                df[x["term"]] += x["df"]
                total[x["term"]] += x["total"]
        assert df[None] == df["hot"] == 140_000 and total["hot"] == sum(i % 300 for i in range(140_000))
        assert all((df[f"w{j:02}"], total[f"w{j:02}"]) == (2_800, sum(i % 300 for i in range(j, 140_000, 50))) for j in range(50))


def test_union_of_mixed_containers():
    ids = [np.packbits(np.arange(BLOCK) % 2 == 0, bitorder="little"), np.array([1, 2, 65_535], np.uint16)]
    counts = [np.full(BLOCK // 2, 3, np.int8), np.array([5, -7, 9], np.int16)]
    assert _dense_union(ids, counts) == (BLOCK // 2 + 2, 3 * BLOCK // 2 + 5 + 9)
    assert _dense_union([ids[1]], [counts[1]]) == (3, 7)

"""Which rows of pattern_result count, and all registered queries on a small table."""

import datetime as dt

from lemmary.llm.patterns import scored_rows
from lemmary.llm.registry import ORACLE, QUERIES

NAN = float("nan")


def test_scored_rows(spark):
    day = lambda d: dt.datetime(2024, 1, d)
    rows = [
        (1, "a", "p", 5, 0.5, day(1)), (1, "a", "p", 6, 0.6, day(2)), (1, "a", "p", 6, 0.6, day(2)),  # the later, once
        (1, "a", "q", 5, 0.5, day(1)), (1, "a", "q", 5, -1.0, day(2)),  # no older row takes its place
        (1, "a", "r", 5, NAN, day(1)), (1, "a", "s", 5, None, day(1)), (1, "a", "t", 5, 1.5, day(1)), (1, "a", "u", 5, 0.0, day(1)),
        (1, None, "p", 5, 0.5, day(1)), (1, "a", "v", 5, 1.0, None), (1, "", "w", None, 1.0, day(1)),
    ]
    df = spark.createDataFrame(rows, "run_id int, key_term string, pattern string, freq bigint, norm_freq double, computed_at timestamp")
    got = sorted((x.key_term, x.pattern, x.freq) for x in scored_rows(df).collect())
    assert got == [("", "w", None), ("a", "p", 6), ("a", "v", 5)]


def test_names():
    for n in (1, 3, 4, 5, 6, 7, 8, 9):
        assert f"p{n}_found" in QUERIES
    assert set(ORACLE) <= set(QUERIES)

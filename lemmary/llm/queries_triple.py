"""Queries over the triple table: problems 3, 4 and 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmary.llm.cooccurrence import item_pairs
from lemmary.llm.frequency import term_frequencies
from lemmary.llm.heavy_hitters import heaviest_values
from lemmary.sources.tables import table


def p3_item_pairs(spark: SparkSession, base: str) -> DataFrame:
    """Pairs of terms in 6 or more rows of a relation, with counts and lift."""
    pairs = item_pairs(table(spark, base, "triple"), "rel", "tid", ["arg1", "arg2", "arg3"], min_pairs=6)
    return pairs.select(F.col("context").alias("rel"), F.col("a").alias("term_a"), F.col("b").alias("term_b"), "n_ab", "n_a", "n_b", "n", F.round("lift", 6).alias("lift"))


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    """The pairs that meet at least 25 times as often as by chance."""
    often = F.col("n_ab") * F.col("n") >= 25 * F.col("n_a") * F.col("n_b")
    return p3_item_pairs(spark, base).where(often).select("rel", "term_a", "term_b")


def p4_top_values(spark: SparkSession, base: str) -> DataFrame:
    """The 25 (rel, arg1, arg2) with the largest summed freq, and that sum."""
    return heaviest_values(table(spark, base, "triple"), ["rel", "arg1", "arg2"], "freq", "tid", k=25, term_cols=("arg1", "arg2"))


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return p4_top_values(spark, base).select("rel", "arg1", "arg2")


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    """Terms of arg1 and arg2 that are too rare or too common."""
    counted = term_frequencies(table(spark, base, "triple"), "tid", ["arg1", "arg2"], "freq")
    return counted.where("mark IS NOT NULL").select("term", "mark")


def p5_term_frequency(spark: SparkSession, base: str) -> DataFrame:
    """Every term of arg1 and arg2 with its record count, summed freq and mark."""
    return term_frequencies(table(spark, base, "triple"), "tid", ["arg1", "arg2"], "freq")


QUERIES = {"p3_found": p3_found, "p3_item_pairs": p3_item_pairs, "p4_found": p4_found, "p4_top_values": p4_top_values, "p5_found": p5_found, "p5_term_frequency": p5_term_frequency}

#: Fixed condition of the reading rules: what an argument must be to be a term.
_IS_TERM = "{0} IS NOT NULL AND trim({0}) NOT IN ('<NONE>', 'None-<NONE-POS>', '<->')"


def _term(c: str) -> str:
    """The canonical spelling of an argument in DuckDB."""
    return f"nfc_normalize(lower(regexp_replace(trim({c}), '-[^-]*$', '')) || regexp_extract(trim({c}), '-[^-]*$'))"


_TERMS = f"""
WITH t AS (SELECT tid, coalesce(max(freq), 0) AS f, any_value(rel) AS rel, any_value(arg1) AS arg1, any_value(arg2) AS arg2, any_value(arg3) AS arg3 FROM triple GROUP BY tid),
  e AS (SELECT DISTINCT tid, f, {_term('a')} AS term FROM (SELECT tid, f, unnest([arg1, arg2]) AS a FROM t) WHERE {_IS_TERM.format('a')}),
  c AS (SELECT term, CAST(count(*) AS BIGINT) AS df, CAST(sum(f) AS BIGINT) AS total FROM e GROUP BY term),
  m AS (SELECT term, df, total, CASE WHEN df <= 2 AND total <= 5 THEN 'rare' WHEN df * 1000 > 3 * (SELECT count(*) FROM t) THEN 'common' END AS mark FROM c)
"""

_PAIRS = f"""
WITH t AS (SELECT tid, any_value(rel) AS rel, any_value(arg1) AS arg1, any_value(arg2) AS arg2, any_value(arg3) AS arg3 FROM triple GROUP BY tid),
  e AS (SELECT DISTINCT rel, tid, {_term('a')} AS term FROM (SELECT rel, tid, unnest([arg1, arg2, arg3]) AS a FROM t) WHERE {_IS_TERM.format('a')}),
  s AS (SELECT rel, term, count(*) AS n FROM e GROUP BY ALL),
  r AS (SELECT rel, count(*) AS n FROM t GROUP BY rel),
  p AS (SELECT x.rel, x.term AS term_a, y.term AS term_b, count(*) AS n_ab FROM e x JOIN e y ON x.tid = y.tid AND x.term < y.term GROUP BY ALL HAVING count(*) >= 6)
SELECT p.rel, term_a, term_b, n_ab, a.n AS n_a, b.n AS n_b, r.n AS n, round(n_ab * CAST(r.n AS DOUBLE) / (CAST(a.n AS DOUBLE) * b.n), 6) AS lift
FROM p JOIN s a ON p.rel = a.rel AND term_a = a.term JOIN s b ON p.rel = b.rel AND term_b = b.term JOIN r ON p.rel = r.rel
"""

_TOP = f"""
SELECT rel, {_term('arg1')} AS arg1, {_term('arg2')} AS arg2, CAST(sum(f) AS BIGINT) AS total
FROM (SELECT tid, any_value(rel) AS rel, any_value(arg1) AS arg1, any_value(arg2) AS arg2, coalesce(max(freq), 0) AS f FROM triple GROUP BY tid)
WHERE {_IS_TERM.format('arg1')} AND {_IS_TERM.format('arg2')}
GROUP BY 1, 2, 3 ORDER BY total DESC, 1, 2, 3 LIMIT 25
"""

ORACLE = {
    "p3_found": f"SELECT rel, term_a, term_b FROM ({_PAIRS}) WHERE n_ab * n >= 25 * n_a * n_b",
    "p3_item_pairs": _PAIRS,
    "p4_found": f"SELECT rel, arg1, arg2 FROM ({_TOP})",
    "p4_top_values": _TOP,
    "p5_found": _TERMS + "SELECT term, mark FROM m WHERE mark IS NOT NULL",
    "p5_term_frequency": _TERMS + "SELECT term, df, total, mark FROM m",
}

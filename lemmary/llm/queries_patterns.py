"""Queries over pattern_result: problems 1 and 6."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmary.llm.enrichment import term_enrichment
from lemmary.llm.patterns import RECORD, scored_rows
from lemmary.llm.topn import top_n
from lemmary.runtime import materialise
from lemmary.sources.tables import table


def _enriched(spark: SparkSession, base: str) -> DataFrame:
    return term_enrichment(scored_rows(table(spark, base, "pattern_result")), RECORD, "pattern", "freq")


def p1_enrichment(spark: SparkSession, base: str) -> DataFrame:
    """Every scored pattern of every record with its enrichment in that record, rounded."""
    return _enriched(spark, base).withColumns({"p_value": F.round("p_value", 4), "q_value": F.round("q_value", 4), "score": F.round("score", 3)})


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    """Of each record the enrichment's most telling pattern that others share."""
    rows = _enriched(spark, base).where("rows >= 3 AND df >= 2 AND score IS NOT NULL")
    # the record's total divides all of its rows alike
    weight = F.round(F.col("freq") * F.log(F.col("records") / F.col("df")), 9)
    best = rows.groupBy(*RECORD).agg(F.min(F.struct((-weight).alias("w"), (-F.col("freq")).alias("f"), "pattern")).alias("b"))
    return best.select(*RECORD, "b.pattern")


def _best() -> list[Column]:
    """The order of problem 6: ties go to the larger freq, then to the smaller pattern."""
    return [F.desc("norm_freq"), F.desc("freq"), F.asc("pattern")]


def _scored(spark: SparkSession, base: str) -> DataFrame:
    """Scored rows, found once and written: their groups are counted before they are ranked."""
    return materialise(scored_rows(table(spark, base, "pattern_result")), "scored")


def p6_run_patterns(spark: SparkSession, base: str) -> DataFrame:
    """The 100 best scored patterns of each run; a run holds a large part of all rows."""
    order = [*_best(), F.asc("key_term")]
    return top_n(_scored(spark, base), ["run_id"], order, 100, heavy_rows=1_000)


def p6_top_patterns(spark: SparkSession, base: str) -> DataFrame:
    """The 3 scored patterns of each record with the highest norm_freq, ranked."""
    return top_n(_scored(spark, base), RECORD, _best(), 3)


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    return p6_top_patterns(spark, base).select(*RECORD, "pattern")


QUERIES = {"p1_found": p1_found, "p1_enrichment": p1_enrichment, "p6_found": p6_found, "p6_run_patterns": p6_run_patterns, "p6_top_patterns": p6_top_patterns}

_SCORED = """
WITH s AS (
  SELECT run_id, key_term, pattern, freq, norm_freq FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id, key_term, pattern ORDER BY computed_at DESC) AS rn FROM pattern_result WHERE key_term IS NOT NULL)
  WHERE rn = 1 AND norm_freq > 0 AND norm_freq <= 1)
"""
_CHOOSE = "lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - {1} + 1)"
_ENRICHED = _SCORED + f""", c AS (SELECT run_id, key_term, pattern, CAST(greatest(coalesce(freq, 0), 0) AS BIGINT) AS freq FROM s),
  r AS (SELECT run_id, key_term, count(*) AS rows, CAST(sum(freq) AS BIGINT) AS record_total FROM c GROUP BY ALL),
  k AS (SELECT pattern, count(*) AS df, CAST(sum(freq) AS BIGINT) AS term_total FROM c GROUP BY ALL),
  w AS (SELECT count(*) AS records, CAST(sum(record_total) AS BIGINT) AS total FROM r),
  j AS (SELECT c.*, rows, record_total, term_total, total, records, df FROM c JOIN r ON c.run_id = r.run_id AND c.key_term = r.key_term JOIN k ON c.pattern = k.pattern, w),
  i AS (SELECT run_id, key_term, pattern, record_total AS n, term_total AS kk, total AS nn, CAST(unnest(generate_series(greatest(freq, record_total + term_total - total), least(record_total, term_total))) AS DOUBLE) AS i FROM j),
  t AS (SELECT run_id, key_term, pattern, {_CHOOSE.format("kk", "i")} + {_CHOOSE.format("(nn - kk)", "(n - i)")} - ({_CHOOSE.format("nn", "n")}) AS lt FROM i),
  m AS (SELECT run_id, key_term, pattern, max(lt) AS top FROM t GROUP BY ALL),
  l AS (SELECT t.run_id, t.key_term, t.pattern, least(any_value(top) + ln(sum(exp(lt - top))), 0.0) AS lp FROM t JOIN m ON t.run_id = m.run_id AND t.key_term = m.key_term AND t.pattern = m.pattern GROUP BY ALL),
  a AS (SELECT *, lp + ln(count(*) OVER () / CAST(row_number() OVER (ORDER BY lp, run_id, key_term, pattern) AS DOUBLE)) AS raw FROM l),
  q AS (SELECT *, least(min(raw) OVER (ORDER BY lp DESC, run_id DESC, key_term DESC, pattern DESC ROWS UNBOUNDED PRECEDING), 0.0) AS lq FROM a)
"""
_TOP = _SCORED + """, t AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY run_id, key_term ORDER BY norm_freq DESC, freq DESC, pattern) AS INTEGER) AS rank FROM s)
"""

ORACLE = {
    "p1_found": _SCORED + """, r AS (SELECT run_id, key_term, count(*) AS rows FROM s GROUP BY ALL),
  p AS (SELECT pattern, count(*) AS df FROM s GROUP BY pattern),
  t AS (SELECT s.*, row_number() OVER (PARTITION BY s.run_id, s.key_term ORDER BY round(s.freq * ln((SELECT count(*) FROM r) / p.df), 9) DESC, s.freq DESC, s.pattern) AS rn
    FROM s JOIN r ON s.run_id = r.run_id AND s.key_term = r.key_term JOIN p ON s.pattern = p.pattern WHERE r.rows >= 3 AND p.df >= 2)
SELECT run_id, key_term, pattern FROM t WHERE rn = 1""",
    "p1_enrichment": _ENRICHED
    + """SELECT j.run_id, j.key_term, j.pattern, freq, rows, record_total, term_total, total, records, df, round(exp(lp), 4) AS p_value, round(exp(lq), 4) AS q_value, abs(round(lq / ln(10.0), 3)) AS score
FROM j JOIN q ON j.run_id = q.run_id AND j.key_term = q.key_term AND j.pattern = q.pattern""",
    "p6_found": _TOP + "SELECT run_id, key_term, pattern FROM t WHERE rank <= 3",
    "p6_run_patterns": _SCORED
    + "SELECT * FROM (SELECT run_id, key_term, pattern, freq, norm_freq, CAST(row_number() OVER (PARTITION BY run_id ORDER BY norm_freq DESC, freq DESC, pattern, key_term) AS INTEGER) AS rank FROM s) WHERE rank <= 100",
    "p6_top_patterns": _TOP + "SELECT run_id, key_term, pattern, freq, norm_freq, rank FROM t WHERE rank <= 3",
}

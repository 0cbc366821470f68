"""Queries over the documents table: problems 7, 8 and 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmary.llm.leakage import leaked_items
from lemmary.llm.mixing import mix_sources
from lemmary.llm.truncation import truncated_texts
from lemmary.sources.tables import table


def p7_leaked_items(spark: SparkSession, base: str) -> DataFrame:
    """Documents that repeat a passage of an eval item, and the words repeated."""
    return leaked_items(table(spark, base, "documents"), table(spark, base, "eval_item"))


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    return p7_leaked_items(spark, base).select("doc_id", "item_id")


def _mixture(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    return mix_sources(table(spark, base, "documents"), table(spark, base, "mix_target"))


def p8_mixture(spark: SparkSession, base: str) -> DataFrame:
    """The documents of the mixture and how often each is used."""
    return _mixture(spark, base)[0]


def p8_shares(spark: SparkSession, base: str) -> DataFrame:
    """The share that each wanted source reaches."""
    return _mixture(spark, base)[1]


def _by_characters(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    return mix_sources(table(spark, base, "documents"), table(spark, base, "mix_target"), size=F.length("text"))


def p8_mixture_by_characters(spark: SparkSession, base: str) -> DataFrame:
    """As :func:`p8_mixture` with characters as the size, which SQL can count."""
    return _by_characters(spark, base)[0]


def p8_shares_by_characters(spark: SparkSession, base: str) -> DataFrame:
    shares = _by_characters(spark, base)[1]
    return shares.withColumns({"budget": F.round("budget", 3), "reached_share": F.round("reached_share", 8)})


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    """The wanted sources that fall short of their share in the mixture reached."""
    return _mixture(spark, base)[1].where("short").select("source")


def p9_truncated(spark: SparkSession, base: str) -> DataFrame:
    """Every document that breaks off, with the reason and the limit it stands at."""
    return truncated_texts(table(spark, base, "documents"))[0]


def p9_sources(spark: SparkSession, base: str) -> DataFrame:
    """The share of broken documents of each source, and its exposed limit."""
    return truncated_texts(table(spark, base, "documents"))[1]


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    return p9_truncated(spark, base).select("doc_id")


QUERIES = {"p9_found": p9_found, "p9_truncated": p9_truncated, "p9_sources": p9_sources, "p7_found": p7_found, "p7_leaked_items": p7_leaked_items, "p8_found": p8_found, "p8_mixture_by_characters": p8_mixture_by_characters, "p8_shares_by_characters": p8_shares_by_characters, "p8_mixture": p8_mixture, "p8_shares": p8_shares}

_MIX = """
WITH m AS (SELECT source, greatest(coalesce(target_share, 0), 0) AS target_share, greatest(coalesce(max_repeat, 1), 0) AS max_repeat FROM mix_target WHERE source IS NOT NULL),
  d AS (SELECT doc_id, source, coalesce(length(text), 0) AS tokens, CAST('0x' || substr(md5('0:' || doc_id), 1, 15) AS BIGINT) AS h FROM documents WHERE source IN (SELECT source FROM m)),
  s AS (SELECT m.*, coalesce(n, 0) AS documents, CAST(coalesce(t, 0) AS BIGINT) AS tokens FROM m LEFT JOIN (SELECT source, count(*) AS n, sum(tokens) AS t FROM d GROUP BY source) USING (source)),
  b AS (SELECT *, target_share * (SELECT CAST(sum(tokens) AS BIGINT) FROM s) AS budget FROM s),
  w AS (SELECT *, CASE WHEN tokens = 0 THEN 0 ELSE least(CAST(floor(budget / tokens) AS BIGINT), max_repeat) END AS whole FROM b),
  n AS (SELECT *, CASE WHEN whole < max_repeat THEN budget - whole * tokens ELSE 0 END AS need FROM w),
  c AS (SELECT d.*, whole, need, sum(d.tokens) OVER (PARTITION BY d.source ORDER BY h) AS upto FROM d JOIN n USING (source)),
  e AS (SELECT *, row_number() OVER (PARTITION BY source, upto > need ORDER BY h) = 1 AND upto > need AS is_edge FROM c),
  p AS (SELECT doc_id, source, tokens, CAST(whole + CASE WHEN need > 0 AND (upto <= need OR (is_edge AND 2 * (need - upto + tokens) >= tokens)) THEN 1 ELSE 0 END AS INTEGER) AS copies FROM e)
"""

#: No SQL tokenizer: which sources fall short is checked with characters as the size.
ORACLE = {
    "p8_mixture_by_characters": _MIX + "SELECT * FROM p WHERE copies > 0",
    "p8_shares_by_characters": _MIX
    + """, r AS (SELECT n.*, CAST(coalesce(reached, 0) AS BIGINT) AS reached_tokens FROM n LEFT JOIN (SELECT source, sum(tokens * copies) AS reached FROM p GROUP BY source) USING (source))
SELECT source, target_share, max_repeat, documents, tokens, round(budget, 3) AS budget, reached_tokens, round(reached_tokens / (SELECT CAST(sum(reached_tokens) AS DOUBLE) FROM r), 8) AS reached_share, max_repeat * tokens < budget AS short FROM r""",
    "p8_found": """
WITH d AS (SELECT source, sum(length(text)) AS size FROM documents GROUP BY source),
  m AS (SELECT m.source, target_share, max_repeat, coalesce(size, 0) AS size FROM mix_target m LEFT JOIN d ON m.source = d.source)
SELECT source FROM m WHERE max_repeat * size < target_share * (SELECT sum(size) FROM m)
""",
}

"""Sentences that connect a source word with a target word of one domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def components(preds: Column) -> Column:
    """Variables of a sentence grouped by connection, as ``array<array<string>>``.

    Predicates that share a variable connect all of their variables; a predicate
    without word joins what it holds like any other. Absent arguments connect
    nothing. A fold over the predicates, inside the row.
    """
    start = F.array().cast("array<array<string>>")

    def merge(groups: Column, p: Column) -> Column:
        mine = F.array_compact(p["args"])
        met = F.filter(groups, lambda g: F.arrays_overlap(g, mine))
        rest = F.filter(groups, lambda g: ~F.arrays_overlap(g, mine))
        joined = F.array_distinct(F.concat(mine, F.flatten(met)))
        return F.when(F.size(mine) == 0, groups).otherwise(F.concat(rest, F.array(joined)))

    return F.aggregate(preds, start, merge)


def _held(preds: Column, words: Column) -> Column:
    """Arguments of each predicate whose lemma is one of the words."""
    return F.transform(F.filter(preds, lambda p: F.array_contains(words, p["lemma"])), lambda p: F.array_compact(p["args"]))


def occurrences(parsed: DataFrame, terms: DataFrame) -> DataFrame:
    """``label, term, file, sid`` of sentences that hold all words of a term
    (``terms``: ``label, term``; words separated by blanks)."""
    words = terms.select("label", "term", F.array_distinct(F.split("term", " ")).alias("words")).select("label", "term", F.size("words").alias("need"), F.explode("words").alias("lemma"))
    found = parsed.select("file", "sid", F.explode(F.array_distinct(F.transform(F.filter("preds", lambda p: p["lemma"].isNotNull()), lambda p: p["lemma"]))).alias("lemma"))
    return found.join(words, "lemma").groupBy("label", "term", "need", "file", "sid").count().where(F.col("count") == F.col("need")).select("label", "term", "file", "sid")


def find_connected(parsed: DataFrame, pairs: DataFrame) -> DataFrame:
    """``file, sid, domain, source, target, raw_text`` of sentences in which an
    occurrence of ``source`` is connected with one of ``target``.

    ``pairs`` has ``label, source, target``. Candidates come from equi-joins on the
    words; connection is then decided inside each candidate's row.
    """
    pairs = pairs.select("label", "source", "target").distinct()
    s = occurrences(parsed, pairs.select("label", F.col("source").alias("term")).distinct()).withColumnRenamed("term", "source")
    t = occurrences(parsed, pairs.select("label", F.col("target").alias("term")).distinct()).withColumnRenamed("term", "target")
    both = s.join(t, ["label", "file", "sid"]).join(pairs, ["label", "source", "target"], "left_semi")
    rows = both.join(parsed.select("file", "sid", "raw_text", "preds"), ["file", "sid"])
    rows = rows.withColumns({"groups": components(F.col("preds")), "a": _held(F.col("preds"), F.split("source", " ")), "b": _held(F.col("preds"), F.split("target", " "))})
    touches = lambda g, sides: F.exists(sides, lambda args: F.arrays_overlap(g, args))
    linked = F.exists("groups", lambda g: touches(g, F.col("a")) & touches(g, F.col("b")))
    return rows.where(linked).select("file", "sid", F.col("label").alias("domain"), "source", "target", "raw_text")


def find_mentions(parsed: DataFrame, pairs: DataFrame) -> DataFrame:
    """``file, sid, domain, source, target``: as :func:`find_connected` but wherever
    both words occur; of each domain the first pair in term order."""
    pairs = pairs.select("label", "source", "target").distinct()
    s = occurrences(parsed, pairs.select("label", F.col("source").alias("term")).distinct())
    t = occurrences(parsed, pairs.select("label", F.col("target").alias("term")).distinct())
    first = lambda d, name: d.groupBy("label", "file", "sid").agg(F.min("term").alias(name))
    return first(s, "source").join(first(t, "target"), ["label", "file", "sid"]).select("file", "sid", F.col("label").alias("domain"), "source", "target")

"""Patterns of a word: its triples with the word replaced by its part of speech."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmary.operators.search import KEY, pattern_rows, seeds_of
from lemmary.operators.store import StopTerms, signature, term_stats
from lemmary.runtime import materialise


def pattern_text(rel: Column, args: Column, kpos: Column) -> Column:
    """``{rel;arg;POS;arg}``: filled slots in order, the word's own as its part of speech."""
    shown = F.array_compact(F.transform(args, lambda x, i: F.when(i == kpos, F.get(signature(rel), kpos)).otherwise(x)))
    return F.concat(F.lit("{"), rel, F.lit(";"), F.array_join(shown, ";"), F.lit("}"))


def find_patterns(store: DataFrame, words: DataFrame, stop: DataFrame | None = None, min_sibling: float = 5.0, min_triples: int = 3, normalize: bool = True) -> DataFrame:
    """``term, rank, pattern, freq, norm_freq, terms`` of each word in ``words.target``.

    ``norm_freq`` is the pattern's frequency over that plus the frequencies of the
    other words that fill it with at least ``min_sibling``. ``terms`` are those of
    them with ``min_triples`` triples, with their share of the word's whole
    frequency, largest first. Patterns whose fixed arguments are all stop terms are
    left out; patterns rank by ``norm_freq`` or, without ``normalize``, by ``freq``.
    """
    stops = StopTerms(stop)
    seeds = seeds_of(store, words)
    others = F.filter(F.transform("args", lambda x, i: F.when(i != F.col("kpos"), x)), lambda x: x.isNotNull() & ~stops.holds(x))
    seeds = materialise(seeds.where(F.size(others) > 0).select("target", *KEY, "args", "freq", "tid"), "seeds")
    rows = pattern_rows(store, seeds).where((F.col("freq") >= min_sibling) & F.col("kterm").isNotNull()).select(*KEY, "kterm", F.col("freq").alias("f"))
    stats = term_stats(store).select(F.col("term").alias("kterm"), "n", F.col("freq").alias("whole"))
    met = seeds.join(rows, KEY, "left")
    met = met.withColumn("kterm", F.when(F.col("kterm") != F.col("target"), F.col("kterm"))).withColumn("f", F.when(F.col("kterm").isNotNull(), F.col("f")))
    met = met.join(stats, "kterm", "left")
    norm = F.col("f") / F.col("whole")
    listed = F.when(F.col("n") >= min_triples, F.struct((-norm).alias("by"), F.col("kterm").alias("term"), F.col("f").alias("freq"), "n", norm.alias("norm")))
    found = met.groupBy("target", "tid", "kpos", "rel", "args", "freq").agg(F.coalesce(F.sum("f"), F.lit(0)).alias("mass"), F.array_sort(F.collect_list(listed)).alias("listed"))
    out = found.select(
        F.col("target").alias("term"),
        pattern_text(F.col("rel"), F.col("args"), F.col("kpos")).alias("pattern"),
        "freq",
        (F.col("freq") / (F.col("freq") + F.col("mass"))).alias("norm_freq"),
        F.transform("listed", lambda x: F.struct(x["term"].alias("term"), x["freq"].alias("freq"), x["n"].alias("n"), x["norm"].alias("norm"))).alias("terms"),
    )
    by = F.desc(F.round("norm_freq", 9)) if normalize else F.desc("freq")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("term").orderBy(by, F.desc("freq"), "pattern")))


def top_patterns(patterns: DataFrame, max_patterns: int = 100, max_terms: int = 100) -> DataFrame:
    """The best patterns of each word with their best terms; 0 keeps all."""
    if max_patterns > 0:
        patterns = patterns.where(F.col("rank") <= max_patterns)
    return patterns if max_terms == 0 else patterns.withColumn("terms", F.slice("terms", 1, max_terms))


def pattern_matrix(patterns: DataFrame, normalize: bool = True) -> DataFrame:
    """``term, row_id, pattern, col_id, col_term, value``: patterns by sibling term,
    both numbered in the order first met."""
    cells = patterns.select("term", "rank", "pattern", F.posexplode("terms").alias("ord", "t"))
    cells = cells.select("term", "rank", "pattern", "ord", F.col("t.term").alias("col_term"), (F.col("t.norm") if normalize else F.col("t.freq").cast("double")).alias("value"))
    columns = cells.groupBy("term", "col_term").agg(F.min(F.struct("rank", "ord")).alias("first"))
    columns = columns.withColumn("col_id", F.row_number().over(Window.partitionBy("term").orderBy("first")) - 1).drop("first")
    return cells.join(columns, ["term", "col_term"]).select("term", (F.col("rank") - 1).alias("row_id"), "pattern", "col_id", "col_term", "value")


def pattern_line(patterns: DataFrame, min_terms: int = 5) -> DataFrame:
    """``term, rank, line``: patterns with at least ``min_terms`` terms as text."""
    # fixed format of the text form
    one = lambda x: F.format_string("%s(f=%d,c=%d,nf=%.8f) ", x["term"], x["freq"], x["n"], x["norm"])
    text = F.format_string("%d\t%.8f\t%s\t%d\t%s", F.col("rank") - 1, "norm_freq", "pattern", F.size("terms"), F.array_join(F.transform("terms", one), ""))
    return patterns.where(F.size("terms") >= min_terms).select("term", "rank", text.alias("line"))


def dense_text(cells: DataFrame, width: DataFrame, by: str) -> DataFrame:
    """``by, row_id, line``: coordinate matrices as blank-separated text rows, with 0 for
    empty cells; ``width`` has each one's largest ``col_id``. For export of matrices
    whose rows fit in memory."""
    held = cells.groupBy(by, "row_id").agg(F.map_from_entries(F.collect_list(F.struct("col_id", "value"))).alias("m"))
    values = F.transform(F.sequence(F.lit(0), F.col("width")), lambda i: F.when(F.map_contains_key(F.col("m"), i), F.format_string("%.16f", F.try_element_at(F.col("m"), i))).otherwise("0"))
    return held.join(width, by).select(by, "row_id", F.concat(F.array_join(values, " "), F.lit(" ")).alias("line"))


def dense_rows(cells: DataFrame) -> DataFrame:
    """``row_id, line`` of one matrix, as :func:`dense_text`."""
    one = cells.withColumn("__all", F.lit(0))
    return dense_text(one, one.groupBy("__all").agg(F.max("col_id").alias("width")), "__all").drop("__all")

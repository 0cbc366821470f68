"""Potential sources of target words: words that share their patterns.

All targets are ranked by one plan: target triples meet their siblings in an
equi-join on (relation, slot, mask, fixed arguments); the mass of a pattern is
summed by that key with map-side combination before rows are scored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmary.operators.search import KEY, pattern_rows, seeds_of
from lemmary.operators.store import StopTerms, is_light
from lemmary.runtime import materialise


def find_sources(
    store: DataFrame,
    targets: DataFrame,
    stop: DataFrame | None = None,
    concept_net: DataFrame | None = None,
    min_freq: int = 5,
    k: int = 100,
    order: list[Column] | None = None,
    minus_one: bool = False,
) -> DataFrame:
    """``target, rank, source, norm_source, norm_target, n, src_freq, tgt_freq, triples``.

    With s and t the frequencies of a sibling and its target triple and P the mass
    of the pattern (siblings that are not light, also those with an empty slot),
    ``norm_source`` sums s / (P + s) and ``norm_target`` t / (P + s). Target triples
    need ``min_freq``; light triples, stop terms (``term``) and words related to the
    target in either direction of ``concept_net`` (``arg1, arg2``) are left out.
    ``k`` = 0 keeps all sources. Ties go to the smaller source. ``minus_one`` lowers
    ``tgt_freq`` by one, as earlier rankings did.
    """
    stops = StopTerms(stop)
    heavy = store.where(~is_light(F.col("args"), F.col("rel"), stops))
    # the few triples of the targets, written once: their true size decides the joins
    seeds = materialise(seeds_of(heavy, targets).where(F.col("freq") >= min_freq).select("target", *KEY, F.col("freq").alias("t")), "seeds")
    rows = pattern_rows(heavy, seeds).select(*KEY, "kterm", F.col("args").alias("sargs"), F.col("freq").alias("s"))
    groups = seeds.select("target", *KEY).distinct()
    mass = rows.join(groups, KEY).where(~F.col("kterm").eqNullSafe(F.col("target"))).groupBy("target", *KEY).agg(F.sum("s").alias("mass"))
    met = seeds.join(mass, ["target", *KEY]).join(rows, KEY).where((F.col("kterm") != F.col("target")) & ~stops.holds(F.col("kterm")))
    if concept_net is not None:
        related = concept_net.select(F.col("arg1").alias("target"), F.col("arg2").alias("kterm"))
        related = related.unionByName(concept_net.select(F.col("arg2").alias("target"), F.col("arg1").alias("kterm"))).distinct()
        met = met.join(related, ["target", "kterm"], "left_anti")
    whole = F.col("mass") + F.col("s")
    met = met.withColumns({"ns": F.col("s") / whole, "nt": F.col("t") / whole})
    met = materialise(met.select("target", F.col("kterm").alias("source"), "ns", "nt", "s", "t", "rel", "sargs"), "shared")
    told = F.sort_array(F.collect_list(F.struct("ns", "rel", "sargs")), asc=False)
    scored = met.groupBy("target", "source").agg(
        F.sum("ns").alias("norm_source"),
        F.sum("nt").alias("norm_target"),
        F.count("*").alias("n"),
        F.sum("s").alias("src_freq"),
        (F.sum("t") - int(minus_one)).alias("tgt_freq"),
    )
    best = Window.partitionBy("target").orderBy(*(order or [F.desc(F.round("norm_source", 9))]), "source")
    ranked = scored.withColumn("rank", F.row_number().over(best))
    # only those that are kept collect their triples
    ranked = ranked if k == 0 else materialise(ranked.where(F.col("rank") <= k), "ranked")
    kept = met if k == 0 else met.join(ranked.select("target", "source"), ["target", "source"], "left_semi")
    triples = F.transform(told, lambda x: F.struct(x["rel"].alias("rel"), x["sargs"].alias("args"), x["ns"].alias("norm")))
    return ranked.join(kept.groupBy("target", "source").agg(triples.alias("triples")), ["target", "source"])


def target_stats(store: DataFrame, targets: DataFrame) -> DataFrame:
    """``target, n, freq``: triples of each target and their summed frequency."""
    held = store.select("freq", F.explode(F.array_distinct("args")).alias("target")).join(targets.select("target").distinct(), "target")
    return held.groupBy("target").agg(F.count("*").alias("n"), F.sum("freq").alias("freq"))


def term_triples_freq(store: DataFrame, targets: DataFrame, stop: DataFrame | None = None, min_freq: int = 0) -> DataFrame:
    """As :func:`target_stats`, over triples above ``min_freq`` that are not light."""
    stops = StopTerms(stop)
    return target_stats(store.where((F.col("freq") > min_freq) & ~is_light(F.col("args"), F.col("rel"), stops)), targets)


def source_line(df: DataFrame) -> DataFrame:
    """``target, rank, line``: ranked sources as tab-separated text."""
    # fixed format of the text form
    one = lambda x: F.concat(F.lit("{"), F.array_join(x["args"], ";", "NONE"), F.lit(";"), F.format_string("%.6f", x["norm"]), F.lit("} "))
    text = F.format_string("%s\t%.8f\t%.8f\t%d\t%d\t%d\t%s", "source", "norm_source", "norm_target", "n", "src_freq", "tgt_freq", F.array_join(F.transform("triples", one), ""))
    return df.select("target", "rank", text.alias("line"))


#: The header of the text form.
HEADER = "source\tsum_of_source_norm_freq\tsum_of_target_norm_freq\tnumber_of_triples\ttotal_pattern_source_triple_freq\ttotal_pattern_target_triple_freq\ttriples"


def source_text(df: DataFrame) -> DataFrame:
    """``target, rank, line``: the text form of every target, its header as rank 0."""
    head = df.select("target").distinct().select("target", F.lit(0).alias("rank"), F.lit(HEADER).alias("line"))
    return head.unionByName(source_line(df))


def matrix_names(cells: DataFrame, by: str, row: str, column: str) -> tuple[DataFrame, DataFrame]:
    """``by, id, name`` of a coordinate matrix's rows and of its columns."""
    rows = cells.select(by, F.col("row_id").alias("id"), F.col(row).alias("name")).distinct()
    return rows, cells.select(by, F.col("col_id").alias("id"), F.col(column).alias("name")).distinct()


def source_matrix(sources: DataFrame, k: int = 0) -> DataFrame:
    """``target, row_id, source, col_id, pattern, value``: ranked sources by pattern.

    Rows are sources in rank order, columns patterns in the order first met; of a
    pattern met twice by a source the last value holds.
    """
    from lemmary.operators.patterns import pattern_text

    if k > 0:
        sources = sources.where(F.col("rank") <= k)
    cells = sources.select("target", "rank", "source", F.posexplode("triples").alias("ord", "t"))
    at = F.filter(F.sequence(F.lit(0), F.size("t.args") - 1), lambda i: F.get(F.col("t.args"), i) == F.col("source"))
    cells = cells.withColumn("pattern", pattern_text(F.col("t.rel"), F.col("t.args"), F.element_at(at, -1)))
    first = F.min(F.struct("rank", "ord"))
    cells = cells.groupBy("target", "rank", "source", "pattern").agg(F.max_by("t.norm", "ord").alias("value"), F.min("ord").alias("ord"))
    columns = cells.groupBy("target", "pattern").agg(first.alias("first"))
    columns = columns.withColumn("col_id", F.row_number().over(Window.partitionBy("target").orderBy("first")) - 1).drop("first")
    return cells.join(columns, ["target", "pattern"]).select("target", (F.col("rank") - 1).alias("row_id"), "source", "col_id", "pattern", "value")

"""Search over the triple store and the sentence index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmary.operators.store import postings


def search_triples(store: DataFrame, terms: DataFrame, query: list[tuple[str, int | None]], rel: str | None = None) -> DataFrame:
    """Triples that hold all terms of ``query`` (each with a slot from 0 or None).

    Terms unknown to the dictionary ``terms`` are left out of the conjunction; if
    none is known the result is empty. The filter reaches the store's scan.
    """
    wanted = sorted({t for t, _ in query})
    known = {x.term for x in terms.where(F.col("term").isin(wanted)).collect()}
    tests = [F.array_contains("args", t) if pos is None else F.get("args", F.lit(pos)) == t for t, pos in query if t in known]
    if not tests:
        return store.limit(0)
    for test in tests:
        store = store.where(test)
    return store if rel is None else store.where(F.col("rel") == rel)


def search_many(store: DataFrame, queries: DataFrame) -> DataFrame:
    """``qid`` and the triples of each query; ``queries`` has ``qid, term, pos``
    (NULL: any slot), all of whose terms must be held."""
    asked = queries.select("qid", "term", F.col("pos").alias("at")).distinct()
    need = asked.groupBy("qid").agg(F.count("*").alias("need"))
    hit = postings(store).join(asked, "term").where(F.col("at").isNull() | (F.col("at") == F.col("pos")))
    full = hit.select("qid", "tid", "term", "at").distinct().groupBy("qid", "tid").count().join(need, "qid").where(F.col("count") == F.col("need"))
    return full.select("qid", "tid").join(store, "tid").select("qid", "tid", "rel", "args", "freq")


KEY = ["rel", "kpos", "mask", "pattern"]


def keyed(store: DataFrame) -> DataFrame:
    """A row for every slot of every triple: ``kpos, kterm`` and the triple."""
    return store.select("tid", "rel", "args", "freq", F.posexplode("args").alias("kpos", "kterm"))


def _mask(args: Column, kpos: Column) -> Column:
    return F.array_join(F.transform(args, lambda x, i: F.when((i == kpos) | x.isNull(), "0").otherwise("1")), "")


def _masked(args: Column, mask: Column) -> Column:
    return F.array_join(F.transform(args, lambda x, i: F.when(F.substring(mask, i + 1, F.lit(1)) == "1", F.concat(i.cast("string"), F.lit("\x02"), x))), "\x01")


def seeds_of(store: DataFrame, targets: DataFrame) -> DataFrame:
    """Triples that hold a ``target``, with the pattern left when it is taken out.

    Empty slots of a seed are wildcards: its mask names the slots that count.
    """
    seeds = keyed(store).join(targets.select("target").distinct(), F.col("kterm") == F.col("target"))
    seeds = seeds.withColumn("mask", _mask(F.col("args"), F.col("kpos")))
    return seeds.withColumn("pattern", _masked(F.col("args"), F.col("mask")))


def pattern_rows(store: DataFrame, seeds: DataFrame) -> DataFrame:
    """Every slot of every triple under each mask that seeds of its relation use."""
    masks = seeds.select("rel", "kpos", "mask").distinct()  # at most 16 for each slot of a relation
    rows = keyed(store).join(F.broadcast(masks), ["rel", "kpos"])
    return rows.withColumn("pattern", _masked(F.col("args"), F.col("mask")))


def siblings(store: DataFrame, targets: DataFrame, strict: bool = False) -> DataFrame:
    """``target, tid, kpos, sibling_tid, sibling, sibling_args, sibling_freq``: triples
    that share a target triple's relation and fixed arguments but not the target.

    An empty slot of the target's triple matches anything; with ``strict`` all slots
    but the target's must be equal, empty ones too.
    """
    seeds = seeds_of(store, targets)
    rows = pattern_rows(store, seeds).select(*KEY, F.col("tid").alias("sibling_tid"), F.col("kterm").alias("sibling"), F.col("args").alias("sibling_args"), F.col("freq").alias("sibling_freq"))
    met = seeds.join(rows, KEY).where(~F.col("sibling").eqNullSafe(F.col("target")))
    if strict:
        rest = lambda c: F.transform(c, lambda x, i: F.when(i != F.col("kpos"), x))
        met = met.where(rest("args") == rest("sibling_args"))
    return met.select("target", "tid", "kpos", "sibling_tid", "sibling", "sibling_args", "sibling_freq")


def lemmas_of(preds: Column) -> Column:
    """The terms of a sentence: lemmas with a part of speech."""
    return F.transform(F.filter(preds, lambda p: p["pos"].isNotNull()), lambda p: p["lemma"])


def sentence_postings(parsed: DataFrame, terms: Callable[[Column], Column] = lemmas_of) -> DataFrame:
    """``term, file, sid`` of each sentence's distinct terms; ``terms`` makes them of its
    predicates."""
    words = F.array_distinct(terms(F.col("preds")))
    return parsed.select("file", "sid", F.explode(words).alias("term")).select("term", "file", "sid")


def search_sentences(index: DataFrame, clauses: list[list[str]], mode: str = "union_all") -> DataFrame:
    """Sentences by clauses of alternative terms.

    A sentence meets a clause if it holds any of its terms. ``union_all`` gives it
    once for each clause it meets, ``and`` once if it meets all.
    """
    if not clauses or not any(clauses):
        return index.select("file", "sid").limit(0)
    spark = index.sparkSession
    asked = spark.createDataFrame([(i, t) for i, c in enumerate(clauses) for t in set(c)], "clause int, term string")
    met = index.join(F.broadcast(asked), "term").select("clause", "file", "sid").distinct()
    if mode == "union_all":
        return met.select("file", "sid")
    return met.groupBy("file", "sid").count().where(F.col("count") == len(clauses)).select("file", "sid")

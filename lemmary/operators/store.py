"""The triple store: counted triples, their postings, dictionary and term statistics.

``store`` tables have ``tid, rel, args, freq``; ``args`` is an array of terms without
part of speech, NULL where a slot is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmary.functions.relations import SIGNATURES
from lemmary.functions.terms import MARKERS
from lemmary.operators.grouped_join import join_stats
from lemmary.runtime import is_small, materialise, maybe_broadcast


def strip_pos(arg: Column) -> Column:
    """A term without its part of speech (what follows the last hyphen)."""
    return F.when(~arg.isin(*MARKERS), F.regexp_replace(arg, "-[^-]*$", ""))


def parse_row(row: Column) -> Column:
    """``struct<rel, args, freq>`` of a counted line ``rel, a1, .., a5, freq``."""
    parts = F.split(row, ", ")
    slots = F.filter(F.slice(parts, 2, 5), lambda a: a != "<->")
    return F.struct(F.get(parts, F.lit(0)).alias("rel"), F.transform(slots, strip_pos).alias("args"), F.try_element_at(parts, F.lit(7)).cast("bigint").alias("freq"))


def counted_triples(triples: DataFrame) -> DataFrame:
    """``tid, rel, args, freq`` summed over files: a ``tid`` counts once, a NULL
    ``freq`` adds 0, and the smallest ``tid`` names the counted triple."""
    once = triples.select("tid", "rel", "args", F.coalesce("freq", F.lit(0)).alias("freq")).dropDuplicates(["tid"])
    return once.groupBy("rel", "args").agg(F.min("tid").alias("tid"), F.sum("freq").alias("freq")).select("tid", "rel", "args", "freq")


def build_store(counted: DataFrame, min_freq: int = 5) -> DataFrame:
    """Triples with a frequency above ``min_freq``."""
    return counted.where(F.col("freq") > min_freq)


def postings(store: DataFrame) -> DataFrame:
    """``term, tid, pos`` (from 0) of every filled slot."""
    return store.select("tid", F.posexplode("args").alias("pos", "term")).where("term IS NOT NULL").select("term", "tid", "pos")


#: Triple identifiers in one block of a posting list.
BLOCK = 1 << 16


def posting_lists(store: DataFrame) -> DataFrame:
    """``term, block, plist``: each term's postings in order, as the index stores them.

    A list is cut into blocks of 65,536 identifiers, so one row holds as many triples
    at most, however frequent its term is.
    """
    listed = F.array_sort(F.collect_list(F.struct("tid", "pos")))
    blocked = postings(store).withColumn("block", F.floor(F.col("tid") / BLOCK))
    return blocked.groupBy("term", "block").agg(listed.alias("plist"))


def dictionary(counted: DataFrame) -> DataFrame:
    """Every term, also of triples below the threshold."""
    return counted.select(F.explode("args").alias("term")).where("term IS NOT NULL").distinct()


def lookup(terms: DataFrame, word: str) -> DataFrame:
    """``word, found``."""
    return terms.where(F.col("term") == word).agg((F.count("*") > 0).alias("found")).select(F.lit(word).alias("word"), "found")


def term_stats(store: DataFrame) -> DataFrame:
    """``term, n, freq``: triples that hold the term in any slot, and their sum."""
    return store.select("freq", F.explode(F.array_distinct("args")).alias("term")).where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("n"), F.sum("freq").alias("freq"))


def signature(rel: Column) -> Column:
    """Parts of speech of a relation's arguments."""
    return F.element_at(F.create_map(*[x for name, s in SIGNATURES.items() for x in (F.lit(name), F.array(*map(F.lit, s)))]), rel)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with dense numbers from 0 in the order of columns, as ``name``.

    Ranks of range partitions are shifted by the counts of those before, so rows
    are never sorted in one task.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    ranged = materialise(ranged, "numbered").withColumn("__range", F.shiftright("__id", 33))
    spans = ranged.groupBy("__range").agg(F.min("__id").alias("first"), F.count("*").alias("k"))  # a row per partition
    before = F.coalesce(F.sum("k").over(Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = materialise(spans.select("__range", (before - F.col("first")).alias("__shift")), "shifts")
    return ranged.join(maybe_broadcast(shift, 1_000_000), "__range").withColumn(name, F.col("__id") + F.col("__shift")).select(name, *df.columns)


def dense_ids(terms: DataFrame) -> DataFrame:
    """``term_id, term`` with dense identifiers from 0 in term order, for export."""
    return numbered(terms.select("term"), ["term"], "term_id")


def _recoded(store: DataFrame, column: str, ids: DataFrame, key: str, value: str, empty: Column) -> DataFrame:
    """``tid`` and the arguments in ``column`` looked up in ``ids``. Empty slots meet
    nothing, and a value that holds many slots is a heavy key."""
    slots = materialise(store.select("tid", F.posexplode(column).alias("pos", key)).where(F.col(key).isNotNull() & (F.col(key) != empty)), "slots")
    counts = slots.groupBy(key).agg(F.count("*").alias("n"))
    stats = materialise(counts.join(ids.select(key, value), key), "codes")
    coded = join_stats(slots, stats, [key], "n", slots.count())
    return coded.groupBy("tid").agg(F.map_from_entries(F.collect_list(F.struct("pos", value))).alias("__held"))


def _filled(column: str, missing: Column) -> Column:
    """The slots of ``column`` from ``__held``, which has a row's few filled ones."""
    return F.transform(F.col(column), lambda _, i: F.coalesce(F.try_element_at(F.col("__held"), i), missing))


def encode_args(store: DataFrame, ids: DataFrame) -> DataFrame:
    """``tid, rel, stamp, freq``: arguments as identifiers, empty slots as -1."""
    coded = _recoded(store, "args", ids, "term", "term_id", F.lit("<NONE>"))
    return store.join(coded, "tid", "left").select("tid", "rel", "freq", _filled("args", F.lit(-1).cast("bigint")).alias("stamp"))


def decode_args(stamped: DataFrame, ids: DataFrame) -> DataFrame:
    """The inverse of :func:`encode_args`."""
    named = _recoded(stamped, "stamp", ids, "term_id", "term", F.lit(-1))
    return stamped.join(named, "tid", "left").select("tid", "rel", "freq", _filled("stamp", F.lit(None).cast("string")).alias("args"))


class StopTerms:
    """Stop terms as literals while they are few; beyond that only by join."""

    MOST = 20_000

    def __init__(self, stop: DataFrame | None):
        self.words: list[str] = []
        if stop is not None:
            if not is_small(stop.select("term").distinct(), self.MOST):
                raise ValueError(f"more than {self.MOST} stop terms; filter arguments with a join before")
            self.words = sorted(x.term for x in stop.select("term").distinct().collect() if x.term is not None)

    def holds(self, term: Column) -> Column:
        return term.isin(self.words) if self.words else F.lit(False)


def is_light(args: Column, rel: Column, stop: StopTerms) -> Column:
    """A triple is light with fewer than two arguments that are filled, no stop
    terms and no prepositions."""
    told = F.zip_with(args, signature(rel), lambda a, pos: a.isNotNull() & ~stop.holds(a) & (pos != "PREP"))
    return F.size(F.filter(told, lambda x: F.coalesce(x, F.lit(False)))) < 2

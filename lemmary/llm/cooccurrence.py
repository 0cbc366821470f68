"""Pairs of items that meet in one basket, and their lift over chance.

Heavy-light decomposition inside every chunk of baskets. Items that hold at least
1/``heavy_share`` of all entries of a chunk are heavy, so there are at most
``heavy_share`` of them. Pairs of heavy items are counted by population counts of
a dense bit matrix (one row per item, one bit per basket), pairs of light items by
counting hashed pair codes, and mixed pairs by probing the heavy rows at the
baskets of each light item's list. The three partial counts are united and summed;
item and basket counts come from the same pass.

Which items are heavy only steers the work inside a chunk; every pair is counted.
Partial counts are handed on whenever a task holds many distinct pairs, so its memory
is bounded in pairs as well as in input.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmary.functions.arrow import chunks
from lemmary.functions.terms import canonical_term, encode
from lemmary.runtime import is_small, materialise

COUNTS = "context string, a string, b string, n bigint"
#: Distinct pairs a task holds before it hands their counts on.
PAIRS_AT_ONCE = 2_000_000
#: Baskets in one bit matrix.
BITS = 1 << 16


class _Tally:
    """Pair codes counted by sorting, folded together when they grow large and handed
    on when that leaves many: memory is bounded however many pairs there are."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for s in range(0, len(keys), self.most):
            some = keys[s : s + self.most]
            n = counts[s : s + self.most] if counts is not None else None
            if n is None:
                some, n = np.unique(some, return_counts=True)
            self.keys.append(some)
            self.counts.append(n)
            self.held += len(some)
            if self.held > self.most:
                some, n = self._fold()
                if len(some) * 2 > self.most:
                    yield some, n
                    some, n = some[:0], n[:0]
                self.keys, self.counts, self.held = [some], [n], len(some)

    def _fold(self) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        n = np.zeros(len(keys), np.int64)
        np.add.at(n, at, np.concatenate(self.counts))
        return keys, n

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.held:
            yield self._fold()


def _pairs(context: np.ndarray, row: np.ndarray, item: np.ndarray, items: int, heavy_share: int, most: int = PAIRS_AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Partial counts ``context, a, b, n`` of pairs; entries are distinct and sorted by
    row, item. A pair is coded by the numbers of its two (context, item) among those
    of the chunk, whose square fits into 64 bits."""
    tally = _Tally(most)
    found, code, n = np.unique(context * items + item, return_inverse=True, return_counts=True)
    width = len(found)
    is_heavy = (n * heavy_share >= max(len(code), 1)) & (n > 1)
    light = ~is_heavy[code]

    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.minimum(a, b) * width + np.maximum(a, b)

    def spelled(counted: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for keys, k in counted:
            a, b = found[keys // width], found[keys % width]
            yield a // items, a % items, b % items, k

    l_row, l_code = row[light], code[light]
    step = 1
    while step < len(l_row):
        same = l_row[step:] == l_row[:-step]
        if not same.any():
            break
        yield from spelled(tally.add(pair(l_code[step:][same], l_code[:-step][same])))
        step += 1

    heavy = np.flatnonzero(is_heavy)
    h_context = found[heavy] // items
    l_context = context[light]
    for c in np.unique(h_context):
        rows = heavy[h_context == c]
        inside = ~light & (context == c)
        h_row, h_code = row[inside], code[inside]
        every = np.unique(h_row)
        mine = l_context == c
        m_row, m_code = l_row[mine], l_code[mine]
        for s in range(0, len(every), BITS):
            baskets = every[s : s + BITS]
            here = slice(*np.searchsorted(h_row, [baskets[0], baskets[-1] + 1]))
            bits = np.zeros((len(rows), (len(baskets) + 63) // 64 * 64), bool)
            bits[np.searchsorted(rows, h_code[here]), np.searchsorted(baskets, h_row[here])] = True
            packed = np.packbits(bits, axis=1).view(np.uint64)
            for i in range(len(rows) - 1):
                k = np.bitwise_count(packed[i] & packed[i + 1 :]).sum(axis=1, dtype=np.int64)
                hit = np.flatnonzero(k)
                yield from spelled(tally.add(pair(rows[i], rows[i + 1 :][hit]), k[hit]))
            # lists of the light items that share a basket with any heavy one
            near = slice(*np.searchsorted(m_row, [baskets[0], baskets[-1] + 1]))
            place = np.searchsorted(baskets, m_row[near])
            shared = baskets[place] == m_row[near]
            place, listed = place[shared], m_code[near][shared]
            for i in range(len(rows)):
                hit = bits[i, place]
                if hit.any():
                    yield from spelled(tally.add(pair(rows[i], listed[hit])))
    yield from spelled(tally.rest())


COUNTS_NAMES = ["context", "a", "b", "n"]


def _counter(heavy_share: int, spell, most: int = PAIRS_AT_ONCE):
    """Columns: context, items; every row is a basket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, size=32 << 20):
            t = t.combine_chunks()
            context, contexts = encode(t.column("context"), lambda v: v)
            contexts.append(None)
            context[context < 0] = len(contexts) - 1
            lists = t.column("items").combine_chunks()
            lists = lists.fill_null([]) if lists.null_count else lists
            item, names = encode(lists.flatten(), spell)
            row = np.repeat(np.arange(t.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            items = max(len(names), 1)
            entry = np.unique((row * items + item)[item >= 0])
            row, item = entry // items, entry % items
            at = context[row]
            single, single_n = np.unique(at * items + item, return_counts=True)
            whole, whole_n = np.unique(context, return_counts=True)
            c_names, i_names = np.array(contexts, dtype=object), np.array([*names, None], dtype=object)
            none = lambda k: np.full(k, len(names))
            for c, a, b, n_ in chain(
                [(single // items, single % items, none(len(single)), single_n), (whole, none(len(whole)), none(len(whole)), whole_n)],
                _pairs(at, row, item, items, heavy_share, most),
            ):
                for s in range(0, len(c), 100_000):
                    e = slice(s, s + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in ((c_names[c[e]], pa.string()), (i_names[a[e]], pa.string()), (i_names[b[e]], pa.string()), (n_[e], pa.int64()))], names=COUNTS_NAMES)

    return run


def _delivered_once(used: DataFrame, few: int = 500_000) -> DataFrame:
    """One row of each ``basket``; rows without one are baskets of their own.

    Only identifiers are shuffled to find those that came more than once; while
    these are few, all other rows stay where they are. Beyond, rows are shuffled.
    """
    again = materialise(used.where("basket IS NOT NULL").groupBy("basket").count().where("count > 1").select("basket"), "again")
    if not is_small(again, few):
        return used.where("basket IS NOT NULL").dropDuplicates(["basket"]).unionByName(used.where("basket IS NULL"))
    again = F.broadcast(again)
    return used.join(again, "basket", "left_anti").unionByName(used.join(again, "basket", "left_semi").dropDuplicates(["basket"]))


def item_pairs(
    df: DataFrame,
    context_col: str,
    basket_col: str,
    item_cols: list[str],
    min_pairs: int = 2,
    heavy_share: int = 512,
    spell=canonical_term,
) -> DataFrame:
    """``context, a, b, n_ab, n_a, n_b, n, lift`` of the pairs ``a < b`` that share at
    least ``min_pairs`` baskets of a context; lift is ``n_ab * n / (n_a * n_b)``.

    ``item_cols`` are string columns, or one array column for baskets of any width.
    A basket (distinct ``basket_col``) counts once however often it is delivered
    (of unequal deliveries one is taken); a NULL identifier makes each row a basket
    of its own. An item counts once per basket; NULL items are none, empty strings
    are items; NULL is a context like any other. A basket without items counts in
    ``n``. An empty table gives no row. Other columns are not read.
    """
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    items = F.col(item_cols[0]).cast("array<string>") if len(item_cols) == 1 and kinds.get(item_cols[0]) == "array" else F.array(*[F.col(c).cast("string") for c in item_cols])
    used = df.select(F.col(context_col).cast("string").alias("context"), F.col(basket_col).alias("basket"), items.alias("items"))
    once = _delivered_once(used).select("context", "items")
    counts = once.mapInArrow(_counter(heavy_share, spell), COUNTS).groupBy("context", "a", "b").agg(F.sum("n").alias("n"))
    counts = materialise(counts.where((F.col("n") >= min_pairs) | F.col("b").isNull()), "pairs")
    same = lambda x, y: x.eqNullSafe(y)
    pairs = counts.where("b IS NOT NULL").withColumnRenamed("n", "n_ab").alias("p")
    # an item of such a pair is in at least as many baskets
    single = counts.where(F.expr("a IS NOT NULL AND b IS NULL") & (F.col("n") >= min_pairs)).select("context", "a", "n")
    sa, sb = single.alias("sa"), single.alias("sb")
    whole = counts.where("a IS NULL").select("context", "n").alias("w")
    out = pairs.join(sa, same(F.col("p.context"), F.col("sa.context")) & (F.col("p.a") == F.col("sa.a")))
    out = out.join(sb, same(F.col("p.context"), F.col("sb.context")) & (F.col("p.b") == F.col("sb.a")))
    out = out.join(whole, same(F.col("p.context"), F.col("w.context")))
    out = out.select(F.col("p.context").alias("context"), "p.a", "p.b", "p.n_ab", F.col("sa.n").alias("n_a"), F.col("sb.n").alias("n_b"), F.col("w.n").alias("n"))
    return out.withColumn("lift", F.col("n_ab").cast("double") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b")))

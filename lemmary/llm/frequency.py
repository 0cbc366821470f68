"""Occurrence and record counts of every distinct term, in vertical layout.

Each map task turns its rows into compressed record-identifier sets, one
container per (term, block of 65,536 identifiers): a sorted array of 16-bit
offsets, or a bitmap once that is smaller, with the occurrence counters of those
records in parallel. Containers of one (term, block) are merged by union, so a
record delivered twice counts once without a shuffle by record; record frequency
is the cardinality of the union and occurrence count the sum of its counters.
A term that holds a third of all rows is spread over its blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmary.functions.arrow import binary, chunks, flat, ints
from lemmary.functions.terms import canonical_term, encode
from lemmary.runtime import materialise

BLOCK_BITS = 16
BLOCK = 1 << BLOCK_BITS
DENSE_FROM = BLOCK // 16  # entries from which a bitmap is smaller than the array
WIDTHS = (np.int8, np.int16, np.int32, np.int64)
CONTAINER = "term string, block bigint, n int, kind tinyint, ids binary, counts binary"


def _containers(code, ids, counts, terms) -> Iterator[pa.RecordBatch]:
    """Containers of one chunk; ``code == len(terms)`` stands for all records."""
    order = np.lexsort((counts, ids, code))
    code, ids, counts = code[order], ids[order], counts[order]
    keep = np.ones(len(code), bool)
    keep[:-1] = (code[1:] != code[:-1]) | (ids[1:] != ids[:-1])
    code, ids, counts = code[keep], ids[keep], counts[keep]
    block, low = ids >> BLOCK_BITS, (ids & (BLOCK - 1)).astype(np.uint16)
    first = np.ones(len(code), bool)
    first[1:] = (code[1:] != code[:-1]) | (block[1:] != block[:-1])
    starts = np.flatnonzero(first)
    if not len(starts):
        return
    n = np.diff(np.append(starts, len(code)))
    high = np.maximum.reduceat(counts, starts)
    low_ = np.minimum.reduceat(counts, starts)
    width = np.full(len(starts), 3, np.int8)
    for w in (2, 1, 0):
        info = np.iinfo(WIDTHS[w])
        width[(high <= info.max) & (low_ >= info.min)] = w
    kind = width + np.where(n > DENSE_FROM, 4, 0).astype(np.int8)
    names = np.array([*terms, None], dtype=object)
    for k in np.unique(kind):
        pick = kind == k
        items = np.repeat(pick, n)
        size = n[pick]
        if k >= 4:
            rows = np.split(low[items], np.cumsum(size)[:-1])
            bits = np.zeros((len(rows), BLOCK), np.uint8)
            for r, x in enumerate(rows):
                bits[r, x] = 1
            lows, low_bytes = np.packbits(bits, axis=1, bitorder="little").ravel(), np.full(len(rows), BLOCK // 8)
        else:
            lows, low_bytes = low[items], 2 * size
        wide = WIDTHS[k & 3]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(names[code[starts[pick]]], pa.string()),
                pa.array(block[starts[pick]], pa.int64()),
                pa.array(size, pa.int32()),
                pa.array(np.full(len(size), k), pa.int8()),
                binary(lows, low_bytes),
                binary(counts[items].astype(wide), size * np.dtype(wide).itemsize),
            ],
            names=["term", "block", "n", "kind", "ids", "counts"],
        )


def _encoder(width: int, spell):
    """Map side. Columns: identifier, count, then ``width`` term columns."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches):
            has_id = pc.is_valid(t.column(0)).combine_chunks().to_numpy(zero_copy_only=False)
            ids, counts = ints(t.column(0))[has_id], ints(t.column(1))[has_id]
            code, terms = encode(pa.chunked_array([x for i in range(width) for x in t.column(2 + i).chunks], pa.string()), spell)
            code = code.reshape(width, -1)[:, has_id]
            row = np.broadcast_to(np.arange(len(ids)), code.shape)[code >= 0]
            every = np.arange(len(ids))
            yield from _containers(
                np.concatenate([code[code >= 0], np.full(len(ids), len(terms))]),
                ids[np.concatenate([row, every])],
                np.concatenate([counts[row], np.zeros(len(ids), np.int64)]),
                terms,
            )

    return run


#: Entries that are merged at once; a (term, block) run is never cut.
ENTRIES = 1 << 21


def _dense_union(ids: list[np.ndarray], counts: list[np.ndarray]) -> tuple[int, int]:
    """Cardinality and summed counters of a union of containers of one (term, block):
    bitmaps are united bit by bit, counters set beside them (the largest of a record)."""
    bits, most = np.zeros(BLOCK // 8, np.uint8), np.full(BLOCK, np.iinfo(np.int64).min)
    for low, count in zip(ids, counts, strict=True):
        if low.dtype == np.uint8:
            bits |= low
            low = np.flatnonzero(np.unpackbits(low, bitorder="little"))
        else:
            np.bitwise_or.at(bits, low >> 3, (1 << (low & 7)).astype(np.uint8))
        most[low] = np.maximum(most[low], count)  # a container holds a record once
    held = np.unpackbits(bits, bitorder="little").view(bool)
    return int(np.bitwise_count(bits).sum()), int(most[held].sum())


def _sparse_union(group: np.ndarray, n: np.ndarray, kind: np.ndarray, ids: pa.Array, counts: pa.Array, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """The same of many small containers at once, by sorting their entries."""
    keys, values = [], []
    for k in np.unique(kind):
        pick = kind == k
        mask = pa.array(pick)
        keys.append((np.repeat(group[pick], n[pick]) << BLOCK_BITS) | flat(ids.filter(mask), np.uint16).astype(np.int64))
        values.append(flat(counts.filter(mask), WIDTHS[k]).astype(np.int64))
    df, total = np.zeros(groups, np.int64), np.zeros(groups, np.int64)
    if keys:
        key, value = np.concatenate(keys), np.concatenate(values)
        order = np.lexsort((value, key))
        key, value = key[order], value[order]
        last = np.ones(len(key), bool)
        last[:-1] = key[1:] != key[:-1]  # of unequal deliveries the largest count
        which = key[last] >> BLOCK_BITS
        df += np.bincount(which, minlength=groups)
        np.add.at(total, which, value[last])
    return df, total


def _union(t: pa.Table, first: np.ndarray) -> pa.RecordBatch:
    """Merge the containers of each (term, block) run; ``first`` marks where one starts."""
    term, ids, counts = (t.column(c).combine_chunks() for c in ("term", "ids", "counts"))
    group, starts = np.cumsum(first) - 1, np.flatnonzero(first)
    kind, n = ints(t.column("kind")), ints(t.column("n"))
    dense = np.zeros(len(starts), bool)
    dense[group[kind >= 4]] = True
    small = ~dense[group]
    mask = pa.array(small)
    df, total = _sparse_union(group[small], n[small], kind[small], ids.filter(mask), counts.filter(mask), len(starts))
    ends = np.append(starts[1:], len(group))
    for g in np.flatnonzero(dense):
        run = range(starts[g], ends[g])
        lows = [np.frombuffer(ids[i].as_buffer(), np.uint8 if kind[i] >= 4 else np.uint16) for i in run]
        df[g], total[g] = _dense_union(lows, [np.frombuffer(counts[i].as_buffer(), WIDTHS[kind[i] & 3]) for i in run])
    return pa.RecordBatch.from_arrays([term.take(pa.array(starts)), pa.array(df, pa.int64()), pa.array(total, pa.int64())], names=["term", "df", "total"])


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce side: whole runs of about ``ENTRIES`` entries are merged at once; a run
    that reaches over a batch's end is carried on."""
    rest: pa.Table | None = None
    for t in chunks(batches, size=32 << 20):
        t = (pa.concat_tables([rest, t]) if rest is not None else t).combine_chunks()
        code = t.column("term").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        block = ints(t.column("block"))
        first = np.ones(len(code), bool)
        first[1:] = (code[1:] != code[:-1]) | (block[1:] != block[:-1])
        starts = np.flatnonzero(first)
        before = np.concatenate([[0], np.cumsum(ints(t.column("n")))])
        at = 0
        while at < starts[-1]:
            # the last start within so many entries, one run at least, the last run left
            end = starts[max(np.searchsorted(before[starts], before[at] + ENTRIES, side="right") - 1, np.searchsorted(starts, at) + 1)]
            yield _union(t.slice(at, end - at), first[at:end])
            at = end
        rest = t.slice(at)
    if rest is not None:
        yield _union(rest, np.arange(rest.num_rows) == 0)


def term_counts(df: DataFrame, id_col: str, term_cols: list[str], count_col: str, spell=canonical_term) -> DataFrame:
    """``term, df, total`` of every term in ``term_cols``; the row with a NULL term
    has the number of distinct records as ``df``.

    A record (distinct ``id_col``) counts once for a term however many of its
    columns or deliveries hold it. NULL counts add 0 and their record still
    counts; rows without an identifier are no record; NULL terms are none; an
    empty string is a term of its own. Deliveries of one record that differ in
    their count add the largest. An empty table gives no row. Columns besides
    those named are not read.
    """
    used = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(count_col).cast("bigint").alias("count"), *[F.col(c).cast("string").alias(f"t{i}") for i, c in enumerate(term_cols)])
    parts = used.mapInArrow(_encoder(len(term_cols), spell), CONTAINER)
    by_block = parts.repartition("term", "block").sortWithinPartitions("term", "block").mapInArrow(_merge, "term string, df bigint, total bigint")
    return by_block.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def term_frequencies(
    df: DataFrame,
    id_col: str,
    term_cols: list[str],
    count_col: str,
    rare_df: int = 2,
    rare_total: int = 5,
    common_per_mille: int = 3,
    spell=canonical_term,
) -> DataFrame:
    """``term, df, total, mark``: ``rare`` if in at most ``rare_df`` records with a
    summed count of at most ``rare_total``, else ``common`` if in more than
    ``common_per_mille`` thousandths of all records, else NULL. Counting is as
    in :func:`term_counts`.
    """
    counted = materialise(term_counts(df, id_col, term_cols, count_col, spell), "terms")
    found = counted.where("term IS NULL").select("df").first()
    records = found[0] if found else 0
    rare = (F.col("df") <= rare_df) & (F.col("total") <= rare_total)
    common = F.col("df") * 1000 > F.lit(common_per_mille * records)
    return counted.where("term IS NOT NULL").withColumn("mark", F.when(rare, "rare").when(common, "common"))

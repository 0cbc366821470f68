"""Evaluation passages inside a training corpus.

A passage leaks if a document holds at least ``min_words`` words in a row of an
item, at most one in ``per_edit`` of them replaced, left out or added. Prefix-
filtered set join on word shingles:

1. The corpus is read once; kept are the positions of shingles that some item has:
   looked up in memory where the items are few, else in a Bloom filter of fixed size,
   whose few false ones a join then removes.
2. Item shingles are ordered by rarity in the corpus. A passage of L words with
   e <= L / per_edit edits keeps at least (L - width + 1) - width * e of its
   shingles, so from every item window the most frequent ones may be left out as
   long as fewer than that are missing: what stays is the necessary prefix.
3. Documents and items meet on prefix shingles only. Length and position bounds
   drop meetings around which no passage of the needed length has room.
4. For each remaining pair the words are aligned around the shared shingles and
   the passage is accepted by its exact edit count.

A passage begins and ends in words that both texts have: a replaced, missing or added
word counts as an edit inside it, so eleven equal words in a row are none, whatever
stands beside them.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmary.functions.arrow import chunks, ints
from lemmary.operators.grouped_join import MAX_HEAVY
from lemmary.runtime import is_small, materialise, maybe_broadcast

#: Most rows that are sent to all tasks of a join.
MOST_SENT = 500_000

_TAG = re.compile(r"</?[A-Za-z!?][^<>]*>")
_MARKS = regex.compile(r"[\p{Mn}\p{Me}\p{Cf}]+")
_WORD = re.compile(r"[^\W_]+")
_LEAD = re.compile(r"[^.:!?…]*[.:!?…]+")


def words(text: str) -> list[str]:
    """Words without markup, letter case, diacritics, punctuation and spacing."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return _WORD.findall(text.casefold())


class _Hashes(dict):
    """Word hashes, kept while they are few."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Order-sensitive hashes of every ``width`` neighbouring word hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.array([], np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = (out ^ hashes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def _item_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Item words, and the words of its first three sentences one by one."""
    for t in chunks(batches, rows=4096):
        ws, leads = [], []
        for text in t.column("text").to_pylist():
            text = text or ""
            ws.append(words(text))
            lead, at = [], 0
            while len(lead) < 3 and (m := _LEAD.match(text, at)):
                lead.append(" ".join(words(m.group())))
                at = m.end()
            leads.append([" ".join(lead[: i + 1]) for i in range(len(lead))])
        yield pa.RecordBatch.from_arrays([t.column("item").combine_chunks(), pa.array(ws, pa.list_(pa.string())), pa.array(leads, pa.list_(pa.string()))], names=["item", "words", "leads"])


def item_words(items: DataFrame, shared_by: int = 3) -> DataFrame:
    """``item, words`` without the opening instruction: up to three opening
    sentences that at least ``shared_by`` different items start with."""
    raw = materialise(items.mapInArrow(_item_words, f"item {items.schema['item'].dataType.simpleString()}, words array<string>, leads array<string>"), "items")
    distinct = raw.select("words", "leads").distinct()
    shared = distinct.select(F.explode("leads").alias("lead")).groupBy("lead").count().where((F.col("count") >= shared_by) & (F.col("lead") != "")).select("lead")
    longest = raw.select("item", "words", F.explode("leads").alias("lead")).join(shared, "lead").groupBy("item", "words").agg(F.max(F.size(F.split("lead", " "))).alias("drop"))
    cut = raw.join(longest, ["item", "words"], "left").withColumn("drop", F.coalesce("drop", F.lit(0)))
    return cut.select("item", F.slice("words", F.col("drop") + 1, F.greatest(F.size("words") - F.col("drop"), F.lit(0))).alias("words"))


def _item_shingles(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for t in chunks(batches, rows=2048):
            kind = t.schema.field("item").type
            for item, ws in zip(t.column("item").to_pylist(), t.column("words").to_pylist(), strict=True):
                h = shingles(np.array([known[w] for w in ws], np.uint64), width).view(np.int64)
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(h), kind), pa.array(np.arange(len(h)), pa.int32()), pa.array(np.full(len(h), len(ws)), pa.int32()), pa.array(h)], names=["item", "ipos", "iwords", "hash"])

    return run


#: Bits of the Bloom filter (32 MB) and bits set by each shingle.
BLOOM_BITS, BLOOM_SET = 1 << 28, 2


def bloom(hashes: DataFrame) -> np.ndarray:
    """The Bloom filter of ``hash`` as 64-bit words: of one size however many there are."""
    bit = F.explode(F.array(*[F.shiftrightunsigned("hash", 36 - 28 * i).bitwiseAND(BLOOM_BITS - 1) for i in range(BLOOM_SET)]))
    words_ = hashes.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).cast("int").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit").bitwiseAND(63).cast("int"))).alias("word"))
    held = words_.toArrow()  # at most BLOOM_BITS / 64 rows
    out = np.zeros(BLOOM_BITS // 64, np.uint64)
    out[held.column("at").to_numpy()] = held.column("word").to_numpy().view(np.uint64)
    return out


def in_bloom(words_: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes the filter may hold."""
    found = np.ones(len(h), bool)
    for i in range(BLOOM_SET):
        bit = (h >> np.uint64(36 - 28 * i)) & np.uint64(BLOOM_BITS - 1)
        found &= (words_[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
    return found


def _doc_shingles(width: int, known_as: Callable[[np.ndarray], np.ndarray]):
    """Positions of the shingles in each document that ``known_as`` finds."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for t in chunks(batches, rows=8192, size=32 << 20):
            doc = t.column("doc").combine_chunks()
            every, sizes = [], []
            for text in t.column("text").to_pylist():
                ws = words(text) if text else []
                every.extend([known[w] for w in ws])
                sizes.append(len(ws))
            sizes = np.array(sizes, np.int64)
            h = shingles(np.array(every, np.uint64), width)
            if not len(h):
                continue
            ends = np.cumsum(sizes)
            row = np.searchsorted(ends, np.arange(len(h)), side="right")
            whole = np.arange(len(h)) + width <= ends[row]
            whole &= known_as(h)
            hit = np.flatnonzero(whole)
            for s in range(0, len(hit), 100_000):
                e = hit[s : s + 100_000]
                r = row[e]
                yield pa.RecordBatch.from_arrays([doc.take(pa.array(r)), pa.array(e - (ends - sizes)[r], pa.int32()), pa.array(sizes[r], pa.int32()), pa.array(h[e].view(np.int64))], names=["doc", "dpos", "dwords", "hash"])

    return run


def _one_of(wanted: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Lookup in a sorted, not empty array."""

    def known_as(h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(wanted, h)
        at[at == len(wanted)] = 0
        return wanted[at] == h

    return known_as


def _necessary(width: int, min_words: int, per_edit: int):
    """Per item, the shingles that must be joined: walking from the most frequent,
    a shingle is left out while every window that could be a passage keeps enough."""
    longest = 2 * max(min_words, per_edit) - 1  # a longer passage has a passage as its half
    spare = {}
    for n in range(min_words, longest + 1):
        spare[n - width + 1] = (n - width + 1) - width * (n // per_edit) - 1

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("ipos")
        n, df = t.num_rows, ints(t.column("df"))
        out = np.zeros(n, np.int64)
        reach = max(spare) - 1
        for i in np.argsort(-df, kind="stable"):
            out[i] = 1
            # only windows around it change
            start, end = max(0, i - reach), min(n, i + reach + 1)
            upto = np.concatenate([[0], np.cumsum(out[start:end])])
            for size, most in spare.items():
                lo, hi = max(0, i - size + 1) - start, min(i, n - size) - start
                if hi >= lo and (most < 1 or (upto[lo + size : hi + size + 1] - upto[lo : hi + 1]).max() > most):
                    out[i] = 0
                    break
        return t.filter(pa.array(out == 0))

    return run


def passage(doc: list[str], item: list[str], width: int, min_words: int, per_edit: int) -> int:
    """Length of the longest accepted passage of the item around a shared shingle, 0 if none.

    Around each maximal run of equal words, the furthest reach to both sides is
    followed for 0, 1, 2, ... edits.
    """
    at: dict[tuple[str, ...], list[int]] = {}
    for i in range(len(item) - width + 1):
        at.setdefault(tuple(item[i : i + width]), []).append(i)
    budget = max(1, (2 * max(min_words, per_edit) - 1) // per_edit + 1)

    def reach(d: int, i: int, step: int) -> list[int]:
        """Most item words reached from (d, i) with 0..budget edits, ending in equal words."""

        def slide(d: int, i: int) -> tuple[int, int]:
            while 0 <= d < len(doc) and 0 <= i < len(item) and doc[d] == item[i]:
                d, i = d + step, i + step
            return d, i

        start = i
        d, i = slide(d, i)
        front, best = {(d, i)}, [abs(i - start)]
        for _ in range(budget):
            moved = set()
            for d, i in front:
                for d2, i2 in ((d + step, i + step), (d + step, i), (d, i + step)):
                    if -1 <= d2 <= len(doc) and -1 <= i2 <= len(item):
                        moved.add((d2, i2))
            front, top = set(), best[-1]
            for d, i in moved:
                d2, i2 = slide(d, i)
                if i2 != i:
                    top = max(top, abs(i2 - start))
                front.add((d2, i2))
            best.append(top)
        return best

    longest, done = 0, set()
    for d in range(len(doc) - width + 1):
        for i in at.get(tuple(doc[d : d + width]), ()):
            if (d - 1, i - 1) in done:
                done.add((d, i))
                continue
            done.add((d, i))
            right, left = reach(d, i, 1), reach(d - 1, i - 1, -1)
            for el, nl in enumerate(left):
                for er, nr in enumerate(right):
                    n = nl + nr
                    if n >= max(min_words, per_edit * (el + er)):
                        longest = max(longest, n)
    return longest


def _meet(hits: DataFrame, rarity: DataFrame, other: DataFrame) -> DataFrame:
    """Join of ``hits`` with ``other`` by ``hash``. ``other`` is broadcast if it is small;
    else that of the hashes that hold over 1/1000 of all hits, whose hits stay in place."""
    if is_small(other, MOST_SENT):
        return hits.join(F.broadcast(other), "hash")
    total = rarity.agg(F.sum("df")).first()[0] or 0
    heavy = materialise(rarity.where(F.col("df") * MAX_HEAVY > F.lit(total)).select("hash"), "heavy-hashes")
    if heavy.isEmpty():
        return hits.join(other, "hash")
    heavy = F.broadcast(heavy) if is_small(heavy, MAX_HEAVY) else heavy
    often = maybe_broadcast(materialise(other.join(heavy, "hash", "left_semi"), "heavy-others"), MOST_SENT)
    rarely = hits.join(heavy, "hash", "left_anti").join(other.join(heavy, "hash", "left_anti"), "hash")
    return rarely.unionByName(hits.join(heavy, "hash", "left_semi").join(often, "hash"))


def _verifier(width: int, min_words: int, per_edit: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, rows=2048, size=32 << 20):
            seen: tuple[str | None, list[str]] = (None, [])
            size = []
            for text, item in zip(t.column("text").to_pylist(), t.column("words").to_pylist(), strict=True):
                if text != seen[0]:
                    seen = (text, words(text))
                size.append(passage(seen[1], item, width, min_words, per_edit))
            keep = pa.array([n > 0 for n in size])
            out = t.select(["doc", "item"]).append_column("n_words", pa.array(size, pa.int32())).filter(keep)
            yield from out.to_batches()

    return run


def leaked_items(
    docs: DataFrame,
    items: DataFrame,
    doc_col: str = "doc_id",
    doc_text: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    width: int = 5,
    min_words: int = 12,
    per_edit: int = 8,
    memory_shingles: int = 2_000_000,
) -> DataFrame:
    """``doc_col, item_col, n_words``: documents that hold a passage of an item, with
    the longest passage found around a shared shingle, in words of the item.

    Opening instructions that three or more different items share are no passage.
    NULL and empty texts hold none; items of fewer than ``min_words`` words never
    match; repeated rows give repeated results once per (document, item); NULL
    identifiers are dropped. Texts are read whole. Columns besides those named are
    not read. Up to ``memory_shingles`` item shingles are sent to the tasks; with
    more, a Bloom filter of them is, and what passes it meets the items in a join.
    """
    d = docs.select(F.col(doc_col).alias("doc"), F.col(doc_text).cast("string").alias("text")).where("doc IS NOT NULL AND text IS NOT NULL")
    i = items.select(F.col(item_col).alias("item"), F.col(item_text).cast("string").alias("text")).where("item IS NOT NULL").dropDuplicates(["item"])
    doc_type, item_type = d.schema["doc"].dataType.simpleString(), i.schema["item"].dataType.simpleString()
    cut = materialise(item_words(i), "item-words")
    ours = materialise(cut.where(F.size("words") >= min_words).mapInArrow(_item_shingles(width), f"item {item_type}, ipos int, iwords int, hash bigint"), "item-shingles")

    unique = materialise(ours.select("hash").distinct(), "shingles")
    schema = f"doc {doc_type}, dpos int, dwords int, hash bigint"
    if is_small(unique, memory_shingles):
        wanted = np.sort(unique.toArrow().column("hash").to_numpy().view(np.uint64))
        hits = d.mapInArrow(_doc_shingles(width, _one_of(wanted)), schema) if len(wanted) else d.sparkSession.createDataFrame([], schema)
    else:
        filter_ = d.sparkSession.sparkContext.broadcast(bloom(unique))
        maybe = materialise(d.mapInArrow(_doc_shingles(width, lambda h: in_bloom(filter_.value, h)), schema), "maybe-hits")
        hits = _meet(maybe, maybe.groupBy("hash").agg(F.count("*").alias("df")), unique).select("doc", "dpos", "dwords", "hash")
    hits = materialise(hits, "hits")

    rarity = materialise(hits.groupBy("hash").agg(F.count("*").alias("df")), "rarity")
    ranked = ours.join(rarity, "hash", "left").select("item", "ipos", "iwords", "hash", F.coalesce("df", F.lit(0).cast("bigint")).alias("df"))
    prefix = ranked.groupBy("item").applyInArrow(_necessary(width, min_words, per_edit), f"item {item_type}, ipos int, iwords int, hash bigint, df bigint")
    prefix = materialise(prefix.where("df > 0").select("item", "ipos", "iwords", "hash"), "prefix")

    # room for a passage around the meeting: words before and after, in either text
    slack = (2 * max(min_words, per_edit) - 1) // per_edit
    before = F.least("dpos", "ipos")
    after = F.least(F.col("dwords") - F.col("dpos"), F.col("iwords") - F.col("ipos"))
    met = _meet(hits, rarity, prefix).where(before + after + slack >= min_words)
    # few next to the corpus: while they are, its texts are not shuffled for them
    pairs = maybe_broadcast(materialise(met.select("doc", "item").distinct(), "met"), MOST_SENT)

    checked = d.join(pairs, "doc").join(cut, "item").select("doc", "item", "text", "words")
    found = checked.mapInArrow(_verifier(width, min_words, per_edit), f"doc {doc_type}, item {item_type}, n_words int")
    return found.groupBy(F.col("doc").alias(doc_col), F.col("item").alias(item_col)).agg(F.max("n_words").alias("n_words"))

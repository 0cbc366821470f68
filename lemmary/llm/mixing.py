"""Mixing sources to target token shares.

Every document gets a 60-bit hash of its identifier. Tokens are summed by source
and by the hash's leading bits; the bucket in which a source's budget runs out is
the only one looked into again, with the next bits, until it holds one hash. All
documents are read once for that; those of boundary buckets, one in thousands, are
written apart for the levels below. A document is taken if its hash lies below its
source's threshold, so nothing is sorted, and a smaller budget always takes a subset
of a larger one.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmary.functions.arrow import chunks
from lemmary.runtime import materialise, maybe_broadcast

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed pattern of the byte-level vocabularies: how text is split before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_RUN = 4_000
_LONG_BLANK = re.compile(r"\s{%d}" % _RUN)
HASH_BITS, LEVEL_BITS = 60, 12
SMALL = 100_000

_LOADED: dict[str, Callable[[str], int]] = {}


def token_counter(path: str) -> Callable[[str], int]:
    """Counts the tokens of a text with a rank file of a public tokenizer; loaded
    once per worker. Runs of white space are cut every 4,000 characters, because
    the splitting pattern would backtrack over them; everything is counted."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

        def count(text: str) -> int:
            if len(text) < _RUN:
                return len(encode(text))
            total, at = 0, 0
            for m in _LONG_BLANK.finditer(text):
                total += len(encode(text[at : m.end()]))
                at = m.end()
            return total + len(encode(text[at:]))

        _LOADED[path] = count
    return _LOADED[path]


def token_counts(df: DataFrame, id_col: str, text_col: str, keep: list[str], tokenizer: str = TOKENIZER) -> DataFrame:
    """``id_col``, ``keep`` and ``tokens``, the tokens of the whole text (NULL: 0)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(tokenizer)
        for t in chunks(batches, rows=8192, size=32 << 20):
            n = pa.array([count(x) if x else 0 for x in t.column("__text").to_pylist()], pa.int64())
            yield from t.drop_columns(["__text"]).append_column("tokens", n).to_batches()

    used = df.select(id_col, *keep, F.col(text_col).cast("string").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in used.schema if f.name != "__text")
    return used.mapInArrow(run, fields + ", tokens bigint")


def identity_hash(id_col: str, seed: int) -> Column:
    """The 60 leading bits of the MD5 of ``seed:id``, which any engine can recompute."""
    text = F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def _histogram(docs: DataFrame, left: int) -> DataFrame:
    """Documents, tokens and extreme hashes by source and the bits above the last ``left``."""
    by = docs.groupBy("source", F.shiftright("hash", left).alias("bucket"))
    return by.agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"), F.min("hash").alias("lo"), F.max("hash").alias("hi"))


def _thresholds(docs: DataFrame, histogram: DataFrame, state: DataFrame) -> DataFrame:
    """``source, threshold, taken``: the hash below which documents are taken once more,
    and the tokens of those.

    ``state`` has ``source, need`` (tokens wanted), ``histogram`` the first level's sums.
    Each further level sums the boundary bucket's documents by the next bits.
    """
    upto = F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket"))
    level = state.withColumn("below", F.lit(0).cast("bigint"))
    settled: DataFrame | None = None
    left = HASH_BITS - LEVEL_BITS
    while True:
        sums = histogram.withColumn("upto", upto).join(level, "source")
        # the first bucket that does not fit as a whole
        over = sums.where(F.col("below") + F.col("upto") > F.col("need")).groupBy("source")
        edge = over.agg(F.min(F.struct("upto", "bucket", "tokens", "need", "below", "lo", "hi")).alias("e"))
        below = F.col("e.below") + F.col("e.upto") - F.col("e.tokens")
        edge = materialise(edge.select("source", "e.need", below.alias("below"), "e.bucket", "e.tokens", "e.lo", "e.hi"), "edges")
        done = edge.where("lo = hi")
        settled = done if settled is None else settled.unionByName(done)
        still = materialise(edge.where("lo < hi").select("source", "need", "below", "bucket"), "open")
        if still.isEmpty():
            break
        inside = docs.join(maybe_broadcast(still.select(F.col("source").alias("s"), "bucket"), SMALL), (F.col("source") == F.col("s")) & (F.shiftright("hash", left) == F.col("bucket")))
        docs = materialise(inside.select("source", "hash", "tokens"), "boundary")
        left = max(0, left - LEVEL_BITS)
        histogram, level = _histogram(docs, left), still.select("source", "need", "below")
    # one hash is left: it is taken if that brings the sum nearer to the budget
    near = F.when(2 * (F.col("need") - F.col("below")) >= F.col("tokens"), 1).otherwise(0)
    return settled.select("source", (F.col("lo") + near).alias("threshold"), (F.col("below") + near * F.col("tokens")).alias("taken"))


def mix_sources(
    docs: DataFrame,
    targets: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    tokenizer: str = TOKENIZER,
    seed: int = 0,
    size: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Documents of a mixture and the shares it reaches.

    ``targets``: ``source`` (unique), ``target_share`` of the total size T, and
    ``max_repeat``, how often a document may be used. T is the tokens of all
    documents of the wanted sources, each used once. Returns

    * ``id_col, source, tokens, copies`` of the documents used at least once: each
      source is repeated as a whole as often as its budget allows, then part of it
      once more; copies of an identifier (same hash) are taken together;
    * a row for each row of ``targets``: ``source, target_share, max_repeat,
      documents, tokens, budget, reached_tokens, reached_share`` (of all tokens
      reached), ``short``: true if every document is used ``max_repeat`` times and
      the tokens so reached stay below the budget.

    ``size`` is an expression over ``docs`` that is used in place of counted tokens.

    Documents without a source, or of a source that is not wanted, do not count;
    a NULL text has 0 tokens; NULL shares are 0 and NULL repeats 1, negative ones
    0; wanted sources without documents are reported with 0 tokens. Other columns
    are not read, so extra ones may have any name.
    """
    wanted = targets.select(
        F.col("source").cast("string").alias("source"),
        F.greatest(F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("target_share"),
        F.greatest(F.coalesce(F.col("max_repeat").cast("int"), F.lit(1)), F.lit(0)).alias("max_repeat"),
    ).where("source IS NOT NULL")
    sizes = F.col(text_col).alias("__text") if size is None else F.coalesce(size.cast("bigint"), F.lit(0).cast("bigint")).alias("tokens")
    mine = docs.select(F.col(id_col).alias("__id"), F.col(source_col).cast("string").alias("source"), sizes)
    mine = mine.join(maybe_broadcast(wanted.select("source").distinct(), SMALL), "source", "left_semi")
    sized = mine if size is not None else token_counts(mine, "__id", "__text", ["source"], tokenizer)
    sized = materialise(sized.withColumn("hash", identity_hash("__id", seed)), "sized")

    histogram = materialise(_histogram(sized, HASH_BITS - LEVEL_BITS), "histogram")
    by_source = histogram.groupBy("source").agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
    plan = wanted.join(by_source, "source", "left").na.fill(0, ["documents", "tokens"])
    all_tokens = F.sum("tokens").over(Window.partitionBy(F.lit(0)))  # one row per wanted source
    plan = plan.withColumn("budget", F.col("target_share") * all_tokens)
    ratio = F.when(F.col("tokens") > 0, F.floor(F.try_divide("budget", "tokens"))).otherwise(0)
    plan = plan.withColumn("whole", F.least(ratio, F.col("max_repeat").cast("bigint")))
    need = F.col("budget") - F.col("whole") * F.col("tokens")
    plan = materialise(plan.withColumn("need", F.when(F.col("whole") < F.col("max_repeat"), need).otherwise(0.0)), "plan")

    cut = _thresholds(sized, histogram, plan.where("tokens > 0 AND need > 0").select("source", "need"))
    # a need of all tokens (by rounding) has no bucket in which it runs out
    every = (F.col("tokens") > 0) & (F.col("need") >= F.col("tokens"))
    threshold = F.coalesce("threshold", F.when(every, 1 << HASH_BITS).otherwise(0))
    taken = F.coalesce("taken", F.when(every, F.col("tokens")).otherwise(0))
    plan = materialise(plan.join(cut, "source", "left").withColumns({"threshold": threshold, "reached_tokens": F.col("whole") * F.col("tokens") + taken}), "mixture")
    used_up = (F.col("whole") >= F.col("max_repeat")) | (F.col("tokens") == 0)
    plan = plan.withColumn("short", used_up & (F.col("reached_tokens") < F.col("budget")))
    rule = maybe_broadcast(plan.select("source", "whole", "threshold"), SMALL)
    copies = F.col("whole") + F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0)
    picked = sized.join(rule, "source").withColumn("copies", copies.cast("int")).where("copies > 0")
    share = F.coalesce(F.try_divide(F.col("reached_tokens"), F.sum("reached_tokens").over(Window.partitionBy(F.lit(0)))), F.lit(0.0))
    report = plan.withColumn("reached_share", share)
    columns = ["source", "target_share", "max_repeat", "documents", "tokens", "budget", "reached_tokens", "reached_share", "short"]
    return picked.select(F.col("__id").alias(id_col), "source", "tokens", "copies"), report.select(columns)

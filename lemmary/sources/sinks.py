"""Text forms of results, and where they are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def triple_line(freq: str = "freq") -> Column:
    """``rel, a1, a2, a3, a4, a5, freq``."""
    return F.concat_ws(", ", "rel", *[f"arg{i}" for i in range(1, 6)], F.col(freq).cast("string"))


def write_lines(df: DataFrame, line: Column, path: str, order: list[Column] | None = None, one_file: bool = False) -> None:
    """Text lines, in order over the files' names if ``order`` is given."""
    out = df.orderBy(*order) if order else df
    out = out.select(line.alias("value"))
    (out.coalesce(1) if one_file else out).write.text(path)


def write_store(store: DataFrame, path: str) -> None:
    """The triple store, ordered by relation inside its files; an error if it exists."""
    store.repartition("rel", F.pmod(F.xxhash64("args"), F.lit(8))).sortWithinPartitions("rel", "args").write.mode("errorifexists").parquet(path)


def write_postings(postings: DataFrame, path: str) -> None:
    """Postings clustered by term, with Bloom filters for lookups of single terms."""
    clustered = postings.repartitionByRange("term", "tid").sortWithinPartitions("term", "tid")
    clustered.write.mode("errorifexists").option("parquet.bloom.filter.enabled#term", "true").parquet(path)


def write_sentence_postings(postings: DataFrame, path: str) -> None:
    """Sentence postings clustered by term."""
    clustered = postings.repartitionByRange("term", "file", "sid").sortWithinPartitions("term", "file", "sid")
    clustered.write.mode("errorifexists").option("parquet.bloom.filter.enabled#term", "true").parquet(path)


def match_line() -> Column:
    """A matched sentence with its domain, words and text (fixed format)."""
    return F.format_string("[id:%d, domain:%s, source:%s, target:%s] \n %s\n", "sid", "domain", "source", "target", F.coalesce("raw_text", F.lit("")))


def write_encoded(df: DataFrame, text: str, path: str, charset: str = "UTF-8") -> None:
    """Lines of ``text`` in another character set, one file a partition.

    The bytes of each line and of the line end are written as they are, so the
    character set must write a line end without a byte order mark (``UTF-16BE``, not
    ``UTF-16``).
    """
    end = "\n".encode(charset).decode("utf-8")
    df.select(F.encode(F.col(text), charset).cast("string").alias("value")).write.option("lineSep", end).text(path)


def write_chunks(chunked: DataFrame, path: str) -> None:
    """A folder for each ``chunk`` of :func:`lemmary.operators.corpus.split_corpus`."""
    parts = chunked.repartition("file", "chunk").sortWithinPartitions("file", "chunk", "line_no")
    parts.select("chunk", F.col("line").alias("value")).write.partitionBy("chunk").text(path)

"""Incremental forms: running triple counts and a sentence index that grows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

ARGS = [f"arg{i}" for i in range(1, 6)]


def running_counts(stream: DataFrame) -> DataFrame:
    """Counts of triples so far; use output mode ``update`` or ``complete``."""
    return stream.groupBy("rel", *ARGS).agg(F.count("*").alias("freq"))


def stream_table(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A Parquet folder, or one file, as a stream of files."""
    schema = spark.read.parquet(path).schema
    path = path.rstrip("/")
    as_glob = f"{path[:-1]}[{path[-1]}]"  # a stream's plain path must be a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(as_glob)


def append_counts(stream: DataFrame, out: str, checkpoint: str, freq_col: str = "freq") -> StreamingQuery:
    """Writes each batch's partial counts under its batch number.

    A batch that runs again after a failure overwrites its own folder, so totals
    (:func:`merged_counts`) hold each record once without state in memory.
    """

    def write(batch: DataFrame, number: int) -> None:
        part = batch.groupBy("rel", *ARGS).agg(F.sum(F.coalesce(freq_col, F.lit(0))).alias("freq"))
        part.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_counts(spark: SparkSession, out: str) -> DataFrame:
    """Totals of the batches written so far."""
    return spark.read.parquet(out).groupBy("rel", *ARGS).agg(F.sum("freq").alias("freq"))


def crawl(files: DataFrame, pairs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Sentences of a stream of ``file, text`` that connect a source with a target of
    ``pairs`` (``label, source, target``), in a folder for each batch."""
    from lemmary.operators.metaphor import find_connected
    from lemmary.sources.logical_form import lines_of_texts, parse_sentences, scan_sentences

    def write(batch: DataFrame, number: int) -> None:
        parsed = parse_sentences(scan_sentences(lines_of_texts(batch, "file", "text")))
        find_connected(parsed, pairs).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_sentences(
    lines: DataFrame,
    out: str,
    checkpoint: str,
    terms: Callable[[Column], Column] | None = None,
    stored: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Extends a sentence index by the files of a stream of ``file, text``: postings
    and sentences go to folders of the batch; identifiers are (file, sid), so none
    has to be handed on between batches. ``terms`` makes the terms of a sentence's
    predicates, ``stored`` the form in which parsed sentences are kept."""
    from lemmary.operators.search import lemmas_of, sentence_postings
    from lemmary.sources.logical_form import lines_of_texts, parse_sentences, scan_sentences

    def write(batch: DataFrame, number: int) -> None:
        parsed = parse_sentences(scan_sentences(lines_of_texts(batch, "file", "text")))
        kept = stored(parsed) if stored else parsed.select("file", "sid", "raw_text", "line")
        kept.write.mode("overwrite").parquet(f"{out}/sentences/batch={number}")
        sentence_postings(parsed, terms or lemmas_of).write.mode("overwrite").parquet(f"{out}/postings/batch={number}")

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

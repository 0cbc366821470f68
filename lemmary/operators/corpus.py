"""Corpus files: combining, merging counts, cutting at sentence ends."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lemmary.functions.arrow import chunks
from lemmary.sources.resources import read_encoded

#: Order of the tab-separated columns of the second format's output.
TOKEN_ORDER = (4, 0, 2, 3, 3, 1, 5, 6)


def combine(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False, charset: str = "UTF-8") -> DataFrame:
    """``file, line_no, line`` of all files that match, decoded."""
    files = read_encoded(spark, path, pattern, recursive, charset)
    return files.select("file", F.posexplode(F.split(F.regexp_replace("text", "\n$", ""), "\n")).alias("line_no", "line"))


def reduce_lines(lines: DataFrame, text_col: str = "line") -> DataFrame:
    """``key, freq``: counts after the last ``", "`` of each line, summed by what
    stands before it."""
    key = F.regexp_extract(text_col, "^(.*), ([0-9]+)\\s*$", 1)
    freq = F.regexp_extract(text_col, "^(.*), ([0-9]+)\\s*$", 2)
    return lines.where(freq != "").groupBy(key.alias("key")).agg(F.sum(freq.cast("bigint")).alias("freq"))


def token_line(line: Column) -> Column:
    """A token line of the second format with its columns permuted."""
    part = F.split(F.rtrim(F.regexp_replace(line, "[\r\n]+$", "")), "\t")
    return F.concat_ws("\t", *[F.get(part, F.lit(i)) for i in TOKEN_ORDER], F.lit("_"), F.lit("_"))


def _plain(lines: DataFrame) -> DataFrame:
    """The second of two blank lines ends a sentence."""
    blank = F.trim("line") == ""
    above = F.lag(blank).over(Window.partitionBy("file").orderBy("line_no"))
    return lines.withColumns({"ends": F.when(blank & F.coalesce(above, F.lit(False)), "before"), "out": F.when(~blank, F.col("line"))})


def _ruwac(lines: DataFrame) -> DataFrame:
    """Text tags end one, a token ``SENT`` after itself, a token numbered 1 before itself."""
    part = F.split("line", "\t")
    tag = F.col("line").startswith("<text") | F.col("line").startswith("</text")
    ends = F.when(tag, "before").when(F.get(part, F.lit(1)) == "SENT", "after").when(F.get(part, F.lit(4)) == "1", "before")
    return lines.withColumns({"ends": ends, "out": F.when(~tag, token_line(F.col("line")))})


#: Formats of corpus files; others can be added by name.
FORMATS: dict[str, Callable[[DataFrame], DataFrame]] = {"plain": _plain, "ruwac": _ruwac}


def sentence_ends(lines: DataFrame, fmt: str = "plain") -> DataFrame:
    """Adds ``ends`` (a sentence ends before or at this line: ``before``, ``after``,
    NULL) and ``out`` (the line as written, NULL for lines that only mark an end), by
    one of ``FORMATS``."""
    return FORMATS[fmt](lines)


def split_corpus(lines: DataFrame, n: int, fmt: str = "plain") -> DataFrame:
    """``file, line_no, chunk, line``: each file cut into about ``n`` chunks.

    A chunk is closed at the first sentence end after its share of the file's bytes
    (each line counts one byte for its end). Files are read in order as a stream, so
    a file of any size needs no more memory than a batch.
    """
    ends = sentence_ends(lines, fmt).withColumn("bytes", F.octet_length("line") + 1)
    sizes = ends.groupBy("file").agg(F.sum("bytes").alias("size"))
    ordered = ends.join(sizes, "file").repartition("file").sortWithinPartitions("file", "line_no")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chunk, read = object(), 1, 0
        for t in chunks(batches, rows=65_536):
            out = []
            for file, end, size, took in zip(*[t.column(c).to_pylist() for c in ("file", "ends", "size", "bytes")], strict=True):
                if file != now:
                    now, chunk, read = file, 1, 0
                read += took
                close = end is not None and read > size // n
                if close and end == "before":
                    chunk, read = chunk + 1, 0
                out.append(chunk)
                if close and end == "after":
                    chunk, read = chunk + 1, 0
            yield from t.select(["file", "line_no", "out"]).append_column("chunk", pa.array(out, pa.int32())).to_batches()

    kind = lines.schema["file"].dataType.simpleString()
    number = lines.schema["line_no"].dataType.simpleString()
    shaped = ordered.select("file", "line_no", "out", "ends", "size", "bytes").mapInArrow(run, f"file {kind}, line_no {number}, line string, chunk int")
    return shaped.where("line IS NOT NULL").select("file", "line_no", "chunk", "line")

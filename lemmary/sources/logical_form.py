"""Logical-form text as sentences and predicates.

A file holds comment lines (``% text``), record marks (``id(N).``, lines that begin
with a digit) and one logical form a line, predicates joined by ``&``. Sentences
are rows with their predicates in an array, so everything that looks at one
sentence afterwards needs no exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Part-of-speech tags of the format and their names.
TAGS = {"vb": "VB", "v": "VB", "nn": "NN", "n": "NN", "adj": "ADJ", "a": "ADJ", "rb": "RB", "r": "RB", "in": "PREP", "p": "PREP", "pr": "PR"}
NO_POS = "<NONE-POS>"

_LEMMA = r"^([^:]*):(.*)-([^-(]*)\(([^-(]*)\)$"
_EXTRA = r"^([^(]+)\((?:.*\()?([^(]*)\)$"


def lines_of_texts(df: DataFrame, file_col: str, text_col: str) -> DataFrame:
    """``file, line_no, line`` of whole texts held in a column."""
    split = F.split(F.col(text_col), "\r?\n")
    return df.where(F.col(text_col).isNotNull()).select(F.col(file_col).alias("file"), F.posexplode(split).alias("line_no", "line"))


def lines_of_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """``file, line_no, line`` of text files; order in a file is kept."""
    reader = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    whole = reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return lines_of_texts(whole, "file", "text")


def scan_sentences(lines: DataFrame) -> DataFrame:
    """``file, sid, raw_text, line`` of the sentences of ``file, line_no, line``.

    ``raw_text`` is the last comment before the sentence, NULL if there is none;
    ``sid`` counts sentences of a file from 0. A comment stands for all sentences
    up to the next one.
    """
    line = F.col("line")
    comment = F.when(line.startswith("%%%"), F.substring(line, 5, 1 << 30)).when(line.startswith("%"), F.substring(line, 3, 1 << 30))
    is_sentence = ~line.startswith("%") & ~line.startswith("id(") & ~line.rlike("^[0-9]") & (F.length(line) > 0)
    by_file = Window.partitionBy("file").orderBy("line_no")
    seen = lines.withColumn("is", is_sentence).where(F.col("is") | line.startswith("%"))
    seen = seen.withColumn("raw_text", F.last(comment, ignorenulls=True).over(by_file.rowsBetween(Window.unboundedPreceding, 0)))
    seen = seen.withColumn("sid", F.sum(F.col("is").cast("bigint")).over(by_file.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return seen.where("is").select("file", "sid", "raw_text", "line")


def parse_args(text: Column) -> Column:
    """Argument list; empty arguments and those that begin with ``u`` are NULL."""
    return F.transform(F.split(text, ","), lambda a: F.when((a != "") & ~a.startswith("u"), a))


def map_pos(tag: Column) -> Column:
    """The name of a part-of-speech tag, NULL for unknown tags."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in TAGS.items() for x in kv]), tag)


def parse_predicate(p: Column) -> Column:
    """``struct<pid, lemma, pos, extra, args>`` of one predicate; lemma and extra are
    NULL where the text is neither ``[pid]:lemma-pos(args)`` nor ``name(args)``.

    Each pattern runs once: its groups come back as one string that is split.
    """
    of_word = F.regexp_replace(p, _LEMMA, "$1\x01$2\x01$3\x01$4")
    of_name = F.regexp_replace(p, _EXTRA, "$1\x01$2")
    parts = F.split(F.when(p.startswith("["), of_word).otherwise(of_name), "\x01")
    get = lambda f, i: F.get(f, F.lit(i))

    def shape(f: Column) -> Column:
        is_word, is_name = F.size(f) == 4, (F.size(f) == 2) & ~p.startswith("[")
        lemma, pos = F.replace(get(f, 1), F.lit(":"), F.lit("")), map_pos(get(f, 2))
        kept = is_word & (lemma != "") & pos.isNotNull()
        return F.struct(
            F.when(kept, get(f, 0)).alias("pid"),
            F.when(kept, lemma).alias("lemma"),
            F.when(kept, pos).alias("pos"),
            F.when(is_name, get(f, 0)).alias("extra"),
            F.when(kept | is_name, parse_args(F.when(is_word, get(f, 3)).otherwise(get(f, 1)))).alias("args"),
        )

    return F.get(F.transform(F.array(parts), shape), F.lit(0))


def parse_sentences(sentences: DataFrame) -> DataFrame:
    """Adds ``preds``: the predicates of ``line`` in order, numbered by ``ppos``.

    Predicates that cannot be read, or have an unknown part of speech, are left out.
    """
    text = F.trim("line")
    for old, new in ((" & ", "&"), ("((", "("), ("))", ")")):
        text = F.replace(text, F.lit(old), F.lit(new))
    parsed = F.transform(F.split(text, "&"), parse_predicate)
    kept = F.filter(parsed, lambda p: p["args"].isNotNull())
    arg = lambda p, i: F.get(p["args"], F.lit(i))
    shaped = F.transform(
        kept,
        lambda p, i: F.struct(i.alias("ppos"), p["pid"].alias("pid"), p["lemma"].alias("lemma"), p["pos"].alias("pos"), p["extra"].alias("extra"), p["args"].alias("args"), *[arg(p, k).alias(f"a{k + 1}") for k in range(4)]),
    )
    return sentences.withColumn("preds", shaped)


def predicates(parsed: DataFrame) -> DataFrame:
    """One row per predicate: ``file, sid, ppos, pid, lemma, pos, extra, args, a1 .. a4``."""
    return parsed.select("file", "sid", F.inline("preds"))


def lemmas(parsed: DataFrame) -> DataFrame:
    """``file, sid, lemmas``: the lemmas of each sentence in order, repeats kept."""
    return parsed.select("file", "sid", F.transform(F.filter("preds", lambda p: p["lemma"].isNotNull()), lambda p: p["lemma"]).alias("lemmas"))


def by_pos(parsed: DataFrame, pos: str) -> DataFrame:
    return predicates(parsed).where(F.col("pos") == pos)


def by_extra(parsed: DataFrame, name: str) -> DataFrame:
    return predicates(parsed).where(F.col("extra") == name)

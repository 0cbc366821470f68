"""Command line: python -m lemmary COMMAND --help.

Every command reads and writes folders that Spark can reach.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmary.operators import corpus, metaphor, patterns, search, sources, store, topics
from lemmary.functions.text import transliterate
from lemmary.operators.relations import extract_triples, fold_triples
from lemmary.runtime import materialise
from lemmary.sources import logical_form, resources, sinks


def _parsed(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return logical_form.parse_sentences(logical_form.scan_sentences(logical_form.lines_of_files(spark, path, pattern)))


def _stop(spark: SparkSession, a: argparse.Namespace) -> DataFrame | None:
    return resources.read_stop_terms(spark, a.stop, a.stop_threshold) if a.stop else None


def triples(spark: SparkSession, a: argparse.Namespace) -> None:
    """Logical-form files to counted triple lines, most frequent first."""
    counted = fold_triples(extract_triples(_parsed(spark, a.input, a.pattern)))
    sinks.write_lines(counted, sinks.triple_line(), a.output, [F.desc("freq"), F.asc("rel"), *[F.asc(f"arg{i}") for i in range(1, 6)]])


def index(spark: SparkSession, a: argparse.Namespace) -> None:
    """Triple lines to a store: triples, postings, dictionary."""
    rows = spark.read.text(a.input).select(store.parse_row(F.col("value")).alias("t")).select("t.*").where("freq IS NOT NULL")
    counted = materialise(rows.groupBy("rel", "args").agg(F.sum("freq").alias("freq")), "counted")
    kept = store.numbered(store.build_store(counted, a.min_freq).select("rel", "args", "freq"), ["rel", "args"], "tid")
    sinks.write_store(kept, f"{a.output}/triples")
    sinks.write_postings(store.postings(spark.read.parquet(f"{a.output}/triples")), f"{a.output}/postings")
    store.dense_ids(store.dictionary(counted)).write.mode("errorifexists").parquet(f"{a.output}/terms")


def _triples_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/triples")


def find_sources(spark: SparkSession, a: argparse.Namespace) -> None:
    """Ranked potential sources of a query's targets, as table and as text."""
    targets = resources.targets(resources.read_queries(spark, a.query))
    concepts = resources.read_concept_pairs(spark, a.concepts, a.relations) if a.concepts else None
    found = sources.find_sources(_triples_of(spark, a.index), targets, _stop(spark, a), concepts, a.min_freq, a.k)
    found.write.mode("errorifexists").parquet(f"{a.output}/table")
    found = spark.read.parquet(f"{a.output}/table")
    if a.topics:  # the text keeps sources that are similar to their target
        found = topics.filter_similar(found, spark.read.parquet(a.topics), a.similarity)
    named = sources.source_text(found).withColumn("target", transliterate(F.col("target")))
    named.orderBy("target", "rank").select("target", "line").write.partitionBy("target").text(f"{a.output}/text")


def _write_matrix(cells: DataFrame, by: str, row: str, column: str, output: str) -> None:
    """Coordinates, the names of rows and columns, and on demand dense text rows."""
    cells.write.mode("errorifexists").parquet(f"{output}/cells")
    cells = cells.sparkSession.read.parquet(f"{output}/cells")
    for part, names in zip(("rows", "columns"), sources.matrix_names(cells, by, row, column), strict=True):
        names.orderBy(by, "id").select(by, F.concat_ws("\t", "id", "name").alias("value")).write.partitionBy(by).text(f"{output}/{part}")
    width = cells.groupBy(by).agg(F.max("col_id").alias("width"))
    patterns.dense_text(cells, width, by).orderBy(by, "row_id").select(by, F.col("line").alias("value")).write.partitionBy(by).text(f"{output}/dense")


def matrix(spark: SparkSession, a: argparse.Namespace) -> None:
    """Ranked sources by pattern: coordinates, names, dense rows."""
    _write_matrix(sources.source_matrix(spark.read.parquet(f"{a.input}/table"), a.k), "target", "source", "pattern", a.output)


def find_patterns(spark: SparkSession, a: argparse.Namespace) -> None:
    """Patterns of words with the words that share them, and their matrix."""
    words = resources.read_terms(spark, a.terms) if a.terms else spark.createDataFrame([(w,) for w in a.word or []], "target string")
    found = patterns.top_patterns(patterns.find_patterns(_triples_of(spark, a.index), words, _stop(spark, a), normalize=a.normalize), a.max_patterns, a.max_terms)
    found.write.mode("errorifexists").parquet(f"{a.output}/table")
    found = spark.read.parquet(f"{a.output}/table")
    _write_matrix(patterns.pattern_matrix(found, a.normalize), "term", "pattern", "col_term", f"{a.output}/matrix")
    patterns.pattern_line(found).orderBy("term", "rank").select(F.col("line").alias("value")).write.text(f"{a.output}/text")


def sentences(spark: SparkSession, a: argparse.Namespace) -> None:
    """Logical-form files to a sentence index."""
    parsed = _parsed(spark, a.input, a.pattern)
    parsed.write.mode("errorifexists").parquet(f"{a.output}/sentences")
    sinks.write_sentence_postings(search.sentence_postings(spark.read.parquet(f"{a.output}/sentences")), f"{a.output}/postings")


def find_text(spark: SparkSession, a: argparse.Namespace) -> None:
    """Texts of sentences that hold any word of every --words group."""
    hits = search.search_sentences(spark.read.parquet(f"{a.index}/postings"), [w.split(",") for w in a.words], a.mode)
    hits.join(spark.read.parquet(f"{a.index}/sentences"), ["file", "sid"]).select(F.coalesce("raw_text", F.lit("")).alias("value")).write.text(a.output)
    print(f"{spark.read.text(a.output).count()} sentences found")


def top(spark: SparkSession, a: argparse.Namespace) -> None:
    """The most frequent triples that hold all --word terms."""
    asked = [(w, None) for w in a.word]
    found = search.search_triples(_triples_of(spark, a.index), spark.read.parquet(f"{a.index}/terms"), asked, a.relation)
    for x in found.orderBy(F.desc("freq"), "tid").limit(a.n).collect():
        print(f"{x.rel}: {', '.join(t or '<NONE>' for t in x.args)}: {x.freq}")


def connected(spark: SparkSession, a: argparse.Namespace) -> None:
    """Sentences that connect a source with a target of a query's domain."""
    parsed = spark.read.parquet(f"{a.index}/sentences") if a.index else _parsed(spark, a.input, a.pattern)
    found = metaphor.find_connected(parsed, resources.domain_pairs(resources.read_queries(spark, a.query)))
    found.select(sinks.match_line().alias("value")).write.text(a.output)


def lookup(spark: SparkSession, a: argparse.Namespace) -> None:
    """Whether a word is in a store's dictionary, and its number."""
    row = spark.read.parquet(f"{a.index}/terms").where(F.col("term") == a.word).first()
    print(f"{a.word}: {row.term_id}" if row else f"{a.word}: not found")


def combine(spark: SparkSession, a: argparse.Namespace) -> None:
    """Files of any character set as lines of another."""
    lines = corpus.combine(spark, a.input, a.pattern, a.recursive, a.charset).orderBy("file", "line_no")
    sinks.write_encoded(lines, "line", a.output, a.output_charset)


def reduce(spark: SparkSession, a: argparse.Namespace) -> None:
    """Counted lines of many files merged, most frequent first."""
    merged = corpus.reduce_lines(corpus.combine(spark, a.input, a.pattern, a.recursive, a.charset))
    sinks.write_lines(merged, F.concat_ws(", ", "key", F.col("freq").cast("string")), a.output, [F.desc("freq"), F.asc("key")])


def split(spark: SparkSession, a: argparse.Namespace) -> None:
    """Files cut at sentence ends into about --chunks pieces each."""
    sinks.write_chunks(corpus.split_corpus(corpus.combine(spark, a.input, a.pattern, a.recursive, a.charset), a.chunks, a.format), a.output)


_PATH = {"--input": {"required": True}, "--output": {"required": True}, "--pattern": {"default": "*"}}
_FILES = {**_PATH, "--recursive": {"action": "store_true"}, "--charset": {"default": "UTF-8"}}
_STORE = {"--index": {"required": True}, "--output": {"required": True}, "--stop": {}, "--stop-threshold": {"type": float, "default": 500.0}}

COMMANDS = {
    "triples": (triples, _PATH),
    "index": (index, {**_PATH, "--min-freq": {"type": int, "default": 5}}),
    "sources": (find_sources, {**_STORE, "--query": {"required": True}, "--concepts": {}, "--relations": {"default": "cds"}, "--min-freq": {"type": int, "default": 5}, "--k": {"type": int, "default": 100}, "--topics": {}, "--similarity": {"type": float, "default": 0.5}}),
    "matrix": (matrix, {"--input": {"required": True}, "--output": {"required": True}, "--k": {"type": int, "default": 100}}),
    "patterns": (find_patterns, {**_STORE, "--word": {"action": "append"}, "--terms": {}, "--max-patterns": {"type": int, "default": 100}, "--max-terms": {"type": int, "default": 100}, "--normalize": {"type": int, "default": 1}}),
    "sentences": (sentences, _PATH),
    "search": (find_text, {"--index": {"required": True}, "--output": {"required": True}, "--words": {"action": "append", "required": True}, "--mode": {"default": "and", "choices": ["and", "union_all"]}}),
    "connected": (connected, {"--index": {}, "--input": {}, "--output": {"required": True}, "--pattern": {"default": "*"}, "--query": {"required": True}}),
    "lookup": (lookup, {"--index": {"required": True}, "--word": {"required": True}}),
    "top": (top, {"--index": {"required": True}, "--word": {"action": "append", "required": True}, "--relation": {}, "--n": {"type": int, "default": 10}}),
    "combine": (combine, {**_FILES, "--output-charset": {"default": "UTF-8"}}),
    "reduce": (reduce, _FILES),
    "split": (split, {**_FILES, "--chunks": {"type": int, "default": 1}, "--format": {"default": "plain", "choices": sorted(corpus.FORMATS)}}),
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lemmary", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (run, options) in COMMANDS.items():
        command = commands.add_parser(name, help=(run.__doc__ or "").split("\n")[0])
        for option, more in options.items():
            command.add_argument(option, **more)
    a = parser.parse_args(argv)
    COMMANDS[a.command][0](spark or SparkSession.builder.appName("lemmary").getOrCreate(), a)


if __name__ == "__main__":
    main()

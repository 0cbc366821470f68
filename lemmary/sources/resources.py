"""Small inputs of searches: queries, stop lists, concept nets, term lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERY_SCHEMA = "query array<struct<label: string, source: array<string>, target: array<string>>>"

#: Short names of concept relations.
CONCEPT_RELATIONS = {"c": "ConceptuallyRelatedTo", "d": "DerivedFrom", "s": "Synonym"}


def multiword(term: Column) -> Column:
    """A term of several words as the store writes it: sorted, joined by ``&&``."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(term, "[ &]+"), lambda w: w != ""))), "&&")


def domains(queries: DataFrame, json_col: str = "value") -> DataFrame:
    """``label, source, target`` (arrays) of JSON queries."""
    parsed = queries.select(F.from_json(F.col(json_col), QUERY_SCHEMA).alias("q"))
    return parsed.select(F.inline("q.query"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return domains(spark.read.text(path, wholetext=True))


def targets(domain: DataFrame) -> DataFrame:
    """``label, target`` of every target term, multiword terms normalised."""
    return domain.select("label", F.explode("target").alias("target")).select("label", multiword(F.col("target")).alias("target")).distinct()


def domain_pairs(domain: DataFrame) -> DataFrame:
    """``label, source, target``: every source term with every target of its domain."""
    return domain.select("label", F.explode("source").alias("source"), "target").select("label", "source", F.explode("target").alias("target")).distinct()


def stop_terms(stop_list: DataFrame, threshold: float = 500.0) -> DataFrame:
    """``term``: lemmas in rank order up to the first frequency below the threshold.

    The first rank below it is found by an aggregate, so nothing is sorted.
    """
    cut = stop_list.where(~(F.col("freq") >= threshold) | F.col("freq").isNull()).agg(F.min("rank").alias("cut"))
    return stop_list.join(F.broadcast(cut), F.col("cut").isNull() | (F.col("rank") < F.col("cut"))).select(F.col("lemma").alias("term")).distinct()


def read_stop_terms(spark: SparkSession, path: str, threshold: float = 500.0) -> DataFrame:
    return stop_terms(spark.read.schema("rank int, freq double, lemma string, pos string").csv(path), threshold)


def concept_pairs(lines: DataFrame, relations: str = "cds") -> DataFrame:
    """``arg1, arg2`` of ``;``-separated lines ``relation;word;word[/pos]``; other
    relations and lines that are too short are skipped."""
    wanted = [CONCEPT_RELATIONS[r] for r in relations if r in CONCEPT_RELATIONS]
    part = F.split("value", ";")
    out = lines.where(F.get(part, F.lit(0)).isin(wanted)).select(F.get(part, F.lit(1)).alias("arg1"), F.regexp_replace(F.get(part, F.lit(2)), "/.*$", "").alias("arg2"))
    return out.dropna()


def read_concept_pairs(spark: SparkSession, path: str, relations: str = "cds") -> DataFrame:
    return concept_pairs(spark.read.text(path), relations)


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """``target``: one term a line, of more than one character."""
    return spark.read.text(path).where(F.length("value") > 1).select(F.col("value").alias("target"))


def read_encoded(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False, charset: str = "UTF-8") -> DataFrame:
    """``file, text`` of files in any character set Spark decodes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select(F.col("path").alias("file"), F.decode("content", charset).alias("text"))

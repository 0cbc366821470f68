"""Similarity of words by their topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit_topics(docs: DataFrame, words_col: str, topics: int = 10, min_df: float = 2.0, vocabulary: int = 50_000, seed: int = 7, iterations: int = 10) -> DataFrame:
    """``term, weights``: topic weights of each word, by latent Dirichlet allocation
    over word lists. The vocabulary is bounded by ``vocabulary``."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer

    counter = CountVectorizer(inputCol=words_col, outputCol="__counts", minDF=min_df, vocabSize=vocabulary).fit(docs)
    model = LDA(k=topics, featuresCol="__counts", seed=seed, maxIter=iterations, optimizer="online").fit(counter.transform(docs))
    weights = model.topicsMatrix().toArray()
    rows = [(t, [float(x) for x in weights[i]]) for i, t in enumerate(counter.vocabulary)]
    return docs.sparkSession.createDataFrame(rows, "term string, weights array<double>")


def similarity(a: Column, b: Column) -> Column:
    """Sum of products of two weight vectors, each normalised to 1; -1 where one is NULL."""
    share = lambda w: F.transform(w, lambda x: x / F.aggregate(w, F.lit(0.0), lambda s, y: s + y))
    dot = F.aggregate(F.zip_with(share(a), share(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.coalesce(dot, F.lit(-1.0))


def topic_similarity(pairs: DataFrame, topics: DataFrame) -> DataFrame:
    """Adds ``similarity`` to ``target, source`` pairs; unknown words give -1."""
    a = topics.select(F.col("term").alias("target"), F.col("weights").alias("__a"))
    b = topics.select(F.col("term").alias("source"), F.col("weights").alias("__b"))
    return pairs.join(a, "target", "left").join(b, "source", "left").withColumn("similarity", similarity(F.col("__a"), F.col("__b"))).drop("__a", "__b")


def filter_similar(pairs: DataFrame, topics: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pairs whose words are similar at least by ``threshold``."""
    return topic_similarity(pairs, topics).where(F.col("similarity") >= threshold)

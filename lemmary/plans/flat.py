"""Array columns as text, so that results compare alike in every engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def flat_query(query: Query, columns: list[str]) -> Query:
    """The query with its array ``columns`` joined by ``;``, NULL as ``NULL``."""

    def run(spark: SparkSession, base: str) -> DataFrame:
        df = query(spark, base)
        text = lambda c: F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("NULL"))), ";")
        return df.withColumns({c: text(F.col(c)) for c in columns})

    return run


def flat_sql(sql: str, columns: list[str]) -> str:
    text = ", ".join(f"array_to_string(list_transform({c}, lambda x: coalesce(CAST(x AS VARCHAR), 'NULL')), ';') AS {c}" for c in columns)
    return f"SELECT * REPLACE ({text}) FROM ({sql})"

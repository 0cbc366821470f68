"""The N best rows of every group, with heavy groups split.

Exact group counts part the groups. Rows of light groups go to an ordinary window.
Rows of heavy groups are salted into as many parts as their count asks for, which keep
their N best; what is left is range-partitioned by group and order, every sorted range
counts its rows of each group, and those counts turn positions inside a range into
ranks of the whole group. No task holds more of one group than a part or a range.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmary.operators.grouped_join import MAX_HEAVY
from lemmary.runtime import materialise, maybe_broadcast

#: A group of more rows is heavy whatever its share, so that no window holds more of one.
MOST_ROWS = 1_000_000
#: How many times the mean a group must be to be heavy.
SKEW = 20


def heavy_groups(sizes: DataFrame, size: str, heavy_rows: int | None = None) -> DataFrame:
    """The rows of ``sizes`` (one per group) whose group is heavy: by measured skew, if it
    is over ``SKEW`` times the mean group and 1/1000 of all rows, or by plain size, over
    ``MOST_ROWS`` rows. ``heavy_rows`` puts a plain number of rows in place of all that."""
    found = sizes.agg(F.count("*").alias("groups"), F.sum(size).alias("rows")).first()
    if not found.groups:
        return sizes
    least = heavy_rows if heavy_rows is not None else min(max(SKEW * found.rows / found.groups, found.rows / MAX_HEAVY), MOST_ROWS)
    return sizes.where(F.col(size) > least)


def top_n(df: DataFrame, group_cols: list[str], order: list[Column], n: int, rank_col: str = "rank", heavy_rows: int | None = None) -> DataFrame:
    """Rows of ``df`` with rank 1 to ``n`` in their group, and the rank.

    ``order`` is a list of sort expressions such as ``F.desc("score")`` and should
    be total for results to be unique; rows equal in it rank arbitrarily but once
    each. Repeated rows are rows of their own. NULL group values form groups like
    any other. Groups with fewer rows are kept whole; ``n`` below 1 and empty tables
    give no rows. Which groups are heavy is said at :func:`heavy_groups`.
    All columns are kept; ``rank_col`` replaces one of that name. ``df`` is read two
    or three times, so it should be a table rather than a long computation.
    """
    df = df.drop(rank_col)
    tag = f"__{uuid.uuid4().hex[:8]}_"  # cannot clash with the columns that are kept
    size, salt, parts, row_id, part, before = (tag + x for x in ("n", "salt", "parts", "id", "range", "before"))
    names = [f"{tag}g{i}" for i in range(len(group_cols))]
    keys = [F.col(c).alias(g) for c, g in zip(group_cols, names, strict=True)]

    def best_of(rows: DataFrame, *by: str) -> DataFrame:
        return rows.withColumn(rank_col, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank_col) <= n)

    sizes = materialise(df.groupBy(*keys).agg(F.count("*").alias(size)), "groups")
    heavy = heavy_groups(sizes, size, heavy_rows)
    if heavy.isEmpty():
        return best_of(df, *group_cols)
    # one part for each share of a task, at least two
    rows_a_part = max(1, (heavy_rows or MOST_ROWS) // 2)
    heavy = materialise(heavy.withColumn(parts, F.greatest(F.ceil(F.col(size) / rows_a_part), F.lit(2))).drop(size), "heavy-groups")
    heavy = maybe_broadcast(heavy, 100 * MAX_HEAVY)

    def same(rows: DataFrame) -> Column:
        return reduce(lambda a, b: a & b, [rows[c].eqNullSafe(F.col(g)) for c, g in zip(group_cols, names, strict=True)], F.lit(True))

    light = best_of(df.join(heavy, same(df), "left_anti"), *group_cols)

    # rows alike fall into one part, where a task passes on N of them at most
    hashed = [f.name for f in df.schema if "map<" not in f.dataType.simpleString() and f.dataType.typeName() != "variant"]
    salted = df.join(heavy, same(df)).withColumn(salt, F.pmod(F.xxhash64(*hashed), F.col(parts)))
    big = best_of(salted, *group_cols, salt).select(*df.columns)
    big = big.repartitionByRange(*group_cols, *order).sortWithinPartitions(*group_cols, *order)
    # the identifier has the range in its upper bits, the position in it below
    ranged = materialise(big.withColumn(row_id, F.monotonically_increasing_id()), "ranges")
    number = F.shiftright(F.col(row_id), 33)
    spans = ranged.groupBy(*keys, number.alias(part)).agg(F.min(row_id).alias(tag + "first"), F.count("*").alias(size))
    sofar = F.sum(size).over(Window.partitionBy(*names).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn(before, F.coalesce(sofar, F.lit(0))).where(F.col(before) < n)
    best = ranged.join(maybe_broadcast(spans, 100 * MAX_HEAVY), same(ranged) & (number == F.col(part)))
    rank = (F.col(row_id) - F.col(tag + "first") + F.col(before) + 1).cast("int")
    return light.unionByName(best.withColumn(rank_col, rank).where(F.col(rank_col) <= n).select(*df.columns, rank_col))

"""Joining per-key statistics back to rows when some keys are very heavy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmary.runtime import is_small, materialise

#: Most keys that can be called heavy; each then holds over 1/MAX_HEAVY of all rows.
MAX_HEAVY = 1_000
#: Most keys whose statistics are broadcast as a whole.
MAX_SMALL = 500_000


def join_stats(rows: DataFrame, stats: DataFrame, keys: list[str], count_col: str, total: int, max_small: int = MAX_SMALL) -> DataFrame:
    """Inner join of ``rows`` with one ``stats`` row per key.

    ``count_col`` of ``stats`` is the number of rows of the key and ``total`` of
    all rows. While ``stats`` have at most ``max_small`` rows and few bytes, all of them are broadcast.
    Beyond, keys that hold more than 1/1000 of all rows are at most 1,000, so
    their statistics are broadcast and their rows stay where they are; only the
    rows of light keys are shuffled. ``stats`` is read several times, so it should be
    a written table. NULL keys do not join.
    """
    if is_small(stats, max_small):
        return rows.join(F.broadcast(stats), keys)
    is_heavy = F.col(count_col) * MAX_HEAVY > F.lit(total)
    heavy = materialise(stats.where(is_heavy), "heavy-keys")
    if heavy.isEmpty():
        return rows.join(stats, keys)
    heavy = F.broadcast(heavy) if is_small(heavy, MAX_HEAVY) else heavy
    light = rows.join(heavy.select(keys), keys, "left_anti").join(stats.where(~is_heavy), keys)
    return light.unionByName(rows.join(heavy, keys))

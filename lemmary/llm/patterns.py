"""Reading rules of pattern_result that problems 1 and 6 share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECORD = ["run_id", "key_term"]


def scored_rows(patterns: DataFrame) -> DataFrame:
    """``run_id, key_term, pattern, freq, norm_freq`` of the current, scored rows.

    Of one (run, key term, pattern) only the row with the latest ``computed_at`` is
    current (of several the one with the largest score, then frequency); it is
    scored if ``norm_freq`` is above 0 and at most 1, and no older row takes its
    place otherwise. Rows without key term do not count.
    """
    known = patterns.where("key_term IS NOT NULL").select(*RECORD, "pattern", F.col("freq").cast("bigint").alias("freq"), F.col("norm_freq").cast("double").alias("norm_freq"), "computed_at")
    now = known.groupBy(*RECORD, "pattern").agg(F.max(F.struct("computed_at", "norm_freq", "freq")).alias("now"))
    now = now.select(*RECORD, "pattern", "now.freq", "now.norm_freq")
    return now.where((F.col("norm_freq") > 0) & (F.col("norm_freq") <= 1))  # NaN is above 1

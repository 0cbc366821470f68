"""Scans read the columns they need and nothing else."""

from lemmary.llm.frequency import term_counts
from lemmary.sources.tables import table


def test_scan_columns(spark, base):
    shown = term_counts(table(spark, base, "triple"), "tid", ["arg1", "arg2"], "freq")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<tid:bigint,arg1:string,arg2:string,freq:bigint>" in shown

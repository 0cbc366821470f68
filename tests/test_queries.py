"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


def value(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(value(x) for x in v)
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (float, np.floating)):
        return int(v) if float(v).is_integer() else round(float(v), 7)
    return int(v) if isinstance(v, (np.integer, np.bool_)) else v


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(map(value, r)) for r in df[columns].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck(base):
    c = duckdb.connect()
    for path in glob.glob(f"{base}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, base, duck, name):
    got = QUERIES[name](spark, base).toPandas()
    if name in ORACLE:
        assert rows(got) == rows(duck.execute(ORACLE[name]).df())
    else:  # what the rows are is tested beside the operator
        assert len(got)


def test_entry(spark, base):
    assert set(ORACLE) <= set(QUERIES)
    flagship = entry.entry(spark)
    kinds = {"target": "string", "rank": "int", "source": "string", "norm_source": "double", "norm_target": "double", "n": "bigint", "src_freq": "bigint", "tgt_freq": "bigint"}
    assert dict(flagship.dtypes) == kinds and flagship.count() > 0

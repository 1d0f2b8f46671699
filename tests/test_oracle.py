"""Every query with an SQL twin must match DuckDB on the small fixture
(row count, column names, order-insensitive values); rows-only queries
must run and return rows with a stable schema."""

import math
import re

import pytest

import __spark_entry__ as E
from conftest import SMALL

# The training-data queries have tests of their own.
OWN = re.compile(r"pipeline$|op\d+_")
QUERIES = {k: v for k, v in E.queries().items() if not OWN.match(k)}
ORACLE = {k: v for k, v in E.oracle_sql().items() if k in QUERIES}
# The largest searches run in test_models.py on fewer candidates.
MODEL_QUERIES = {"grid_search_rf", "grid_search_gb", "random_search", "train_many"}


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4) + 0.0
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, int):
        return float(v)
    return str(v)


def _rows(pdf):
    cols = sorted(pdf.columns)
    return sorted(repr(tuple(_norm(r[c]) for c in cols)) for r in pdf.to_dict("records"))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, duck, name):
    sp = QUERIES[name](spark, SMALL).toPandas()
    dk = duck.execute(ORACLE[name]).df()
    assert len(sp) == len(dk)
    assert sorted(sp.columns) == sorted(dk.columns)
    assert _rows(sp) == _rows(dk)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - MODEL_QUERIES))
def test_rows_only(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert df.count() > 0
    assert len(df.columns) > 0


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "neighborhood" in df.columns

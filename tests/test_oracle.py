"""Every query that has SQL against DuckDB on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from marlstone.plans import registry
from marlstone.session import TABLES


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(df):
    def value(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)):
            return ""
        return f"{float(v):.5g}" if isinstance(v, (float, np.floating)) else str(int(v)) if isinstance(v, (np.integer, int)) and not isinstance(v, bool) else str(v)[:10] if hasattr(v, "year") else str(v)

    out = df[sorted(df.columns)].astype(object).map(value)
    return sorted(map(tuple, out.to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, data, duck, name):
    got, want = registry.queries()[name](spark, data).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    ints = [c for c in got.columns if want[c].dtype.kind in "iu" or str(want[c].dtype).startswith("Int")]
    got[ints] = got[ints].astype("Int64")
    want[ints] = want[ints].astype("Int64")
    assert plain(got) == plain(want)


def test_no_shipped_query_needs_a_nested_loop(spark, data):
    for name in ("agg8_join15_correlations", "sim1_join8_training", "join16_interval", "join16_asof"):
        plan = registry.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_nothing_outside_imports_the_text_subpackage():
    import pathlib
    import re

    root = pathlib.Path(registry.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"marlstone\.llm|from \.llm", p.read_text()), p


def test_flagship(spark, data):
    assert registry.flagship(spark, data).count() > 0

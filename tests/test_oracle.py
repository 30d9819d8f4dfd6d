"""Every registered point-cloud query that has SQL gives the same rows in DuckDB."""

import numpy as np
import pandas as pd
import pytest

from cloudloom.plans import catalog
from tests.conftest import SMALL


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        plain = df[c].dtype != object and not str(df[c].dtype).startswith(("str", "bool"))
        df[c] = pd.to_numeric(df[c]).astype(float).round(9) if plain else df[c].astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows(name, spark, duck):
    got, want = canonical(catalog.QUERIES[name](spark, SMALL).toPandas()), canonical(duck.sql(catalog.ORACLE_SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    for c in got.columns:
        same = got[c] == want[c] if got[c].dtype == object else np.isclose(got[c], want[c], rtol=0, atol=1e-9, equal_nan=True)
        assert same.all(), c


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs_alike_for_any_partitioning(name, spark):
    one = canonical(catalog.QUERIES[name](spark, SMALL).toPandas())
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        other = canonical(catalog.QUERIES[name](spark, SMALL).toPandas())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(one) > 0
    pd.testing.assert_frame_equal(one, other, check_exact=False, atol=1e-6)

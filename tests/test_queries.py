"""Every query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from priorkit import registry
from priorkit.plans import learners, pipelines, regimes, taxonomies

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Run whole by tests of their own.
ELSEWHERE = {*regimes.QUERIES, *learners.QUERIES, *taxonomies.QUERIES, *pipelines.QUERIES, "pair_svd", "minimax_blend"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def text(v):
    if pd.api.types.is_scalar(v) and pd.isna(v):
        return ""
    return repr(float(v) + 0.0) if hasattr(v, "__float__") else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(text, r)) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - ELSEWHERE))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.ORACLES:
        assert rows(got) == rows(duck.execute(registry.ORACLES[name]).df())
    else:
        assert list(got.columns)

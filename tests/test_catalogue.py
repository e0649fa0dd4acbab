"""Every registered query of the engine against its SQL."""

import os

import duckdb
import pytest

from volquery.plans import arrays, stored  # noqa: F401 (they add their queries)
from volquery.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "events embeddings part nation".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")


def plain(value):
    return value.tolist() if hasattr(value, "tolist") else value


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, sql, name):
    got, want = QUERIES[name](spark, SF).toPandas(), sql.sql(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want) > 0
    rows = [sorted(repr([plain(v) for v in r]) for r in f[columns].itertuples(index=False)) for f in (got, want)]
    assert rows[0] == rows[1]

"""Every registered query of the library that has SQL, against that SQL, on the smallest tables."""

import duckdb
import pytest

from facetline import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries whose result may be empty on the smallest tables.
MAY_BE_EMPTY: set[str] = set()


def _row(r) -> str:
    return str(tuple(float(x) if isinstance(x, float) else x for x in r))


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for t in TABLES:
        found.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return found


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    found = con.execute(plans.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    got = plans.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(_row(r) for r in got.select(*columns).collect()) == sorted(_row(r) for r in found.fetchall())

"""Every query that has SQL gives DuckDB's rows on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tidemark import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
QUERIES, ORACLES = plans.gathered("QUERIES"), plans.gathered("ORACLES")


#: Outputs of machines that the smallest tables may not have.
SPARSE = {"zone_joints", "zone_rearms", "zone_extensions", "zone_price_regimes", "zone_ema_regimes"}


@pytest.fixture(scope="module")
def duck():
    if not Path(SF).exists():
        pytest.skip("the tables aren't here")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if value != value else float(f"{value:.9g}")
    return value.replace(tzinfo=None) if hasattr(value, "tzinfo") else value


def ordered(rows, columns, names):
    at = [names.index(c) for c in columns]
    return sorted(repr(tuple(plain(r[k]) for k in at)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_agrees(spark, duck, name):
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    got = duck.execute(ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    assert ordered(found.collect(), columns, found.columns) == ordered(got.fetchall(), columns, names)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_without_sql(spark, duck, name):
    found = QUERIES[name](spark, SF)
    assert len(set(found.columns)) == len(found.columns)
    assert found.count() > 0 or name in SPARSE


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)

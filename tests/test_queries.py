"""Every registered query of the library against its DuckDB counterpart."""

import duckdb
import pytest

from ledgerlight.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(tuple("-" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in row) for row in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    assert len(set(columns)) == len(columns)
    got = df.select(*(f"`{c}`" for c in columns)).collect()
    if sql := registry.oracle_sql().get(name):
        want = duck.sql(sql)
        assert sorted(want.columns) == columns
        assert plain(got) == plain(want.select(*(f'"{c}"' for c in columns)).fetchall())

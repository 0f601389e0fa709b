"""Every catalogue query against its SQL in DuckDB, as the driver compares them."""

import duckdb
import pytest

from lodewright.plans import catalogue, further  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents benchmark labels conversations pages".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(values, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    tidy = lambda v: round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return sorted((tuple(tidy(r[i]) for i in order) for r in values), key=str), [names[i] for i in order]


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, con, name):
    df = catalogue.QUERIES[name](spark, sf)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    if name in catalogue.SQL:
        cur = con.execute(catalogue.SQL[name])
        assert got == rows(cur.fetchall(), [d[0] for d in cur.description])
    else:
        assert got[0]

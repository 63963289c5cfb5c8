"""Every query beside its SQL in DuckDB on the small tables."""

import decimal
import os

import duckdb
import pytest

from fieldloom.plans import catalog, document_queries, license_queries

DIR = "/root/testdata/sf0.001"


def rows(columns, found):
    def cell(v):
        v = float(v) if isinstance(v, decimal.Decimal) else v
        return None if v is None or v != v else round(v, 6) if isinstance(v, float) else v

    return sorted(columns), sorted([str(cell(v)) for _, v in sorted(zip(columns, r))] for r in found)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return con


@pytest.fixture(scope="module", autouse=True)
def shared():
    """Tables that many queries begin with are computed once for this module; the queries themselves run as they are."""
    kept, patch = {}, pytest.MonkeyPatch()

    def once(module, name):
        made = getattr(module, name)

        def get(spark, sf, *more):
            if more:
                return made(spark, sf, *more)
            if name not in kept:
                kept[name] = made(spark, sf).persist()
            return kept[name]

        patch.setattr(module, name, get)

    for name in ("fields", "comparisons", "failed"):
        once(license_queries, name)
    for name in ("visa_record", "letters_read"):
        once(document_queries, name)
    yield
    patch.undo()
    for df in kept.values():
        df.unpersist()


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, DIR)
    cur = con.execute(catalog.SQL[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in cur.description], cur.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

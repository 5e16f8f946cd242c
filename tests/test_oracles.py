"""Every query of the engine's own operators against its SQL in DuckDB, over the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from quarryline.plans import catalogue


def normal(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or isinstance(v, float) and v != v:
            return None
        return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    df = df[sorted(df.columns)]
    return sorted((tuple(map(cell, r)) for r in df.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, sf, duck, name):
    got, want = catalogue.queries()[name](spark, sf).toPandas(), duck.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, sf, name):
    assert catalogue.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_every_heading_has_a_slug(spark, sf, duck):
    """By Python's own expressions, headings of any alphabet included."""
    import re

    want = {i: re.sub("[^a-z0-9]+", "-", x.split("\n")[0].strip().lower()).strip("-") for i, x in duck.execute("SELECT doc_id, text FROM documents").fetchall()}
    got = {r.doc_id: r.slug for r in catalogue.queries()["heading_slug_all"](spark, sf).collect()}
    assert got == want and len(got) > catalogue.queries()["heading_slug"](spark, sf).count()

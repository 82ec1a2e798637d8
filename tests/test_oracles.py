"""Every catalogue query equals its SQL on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from leafmill.plans import catalogue, page_catalogue, record_catalogue, sheet_catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


#: Queries whose rules need more pages a book than the smallest tables have.
LARGER = {"folio_place_model", "folio_in_position", "folio_bracket_recovery", "folio_resolved", "folio_gap_warnings"}


def tables(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.fixture(scope="module")
def con():
    return tables(SF)


def canonical(df: pd.DataFrame) -> list[tuple]:
    """Sorted rows; a whole number is one whether nulls made its column a float or not."""

    def plain(x):
        if isinstance(x, float):
            return None if pd.isna(x) else str(int(x)) if x == int(x) else round(x, 5)
        return None if pd.isna(x) else str(x)

    df = df[sorted(df.columns)]
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=str)


QUERIES = catalogue.QUERIES | page_catalogue.QUERIES | sheet_catalogue.QUERIES | record_catalogue.QUERIES
ORACLE_SQL = catalogue.ORACLE_SQL | page_catalogue.ORACLE_SQL | sheet_catalogue.ORACLE_SQL | record_catalogue.ORACLE_SQL


def test_names_are_registered_once():
    assert len(QUERIES) == sum(len(c.QUERIES) for c in (catalogue, page_catalogue, sheet_catalogue, record_catalogue))


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    sf = SF.replace("sf0.001", "sf0.01") if name in LARGER else SF
    ours = QUERIES[name](spark, sf).toPandas()
    theirs = (tables(sf) if name in LARGER else con).execute(ORACLE_SQL[name]).df()
    assert list(sorted(ours.columns)) == list(sorted(theirs.columns))
    assert canonical(ours) == canonical(theirs)
    assert len(ours)

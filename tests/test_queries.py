"""Every registered query against its SQL on the small tables; those without SQL must give rows."""

import math

import duckdb
import pandas as pd
import pytest

from shelfmark.plans import catalog, registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()
#: Queries whose conditions no row of the small tables meets.
MAY_BE_EMPTY = {"ag20_shipping_estimate", "q19_substitutes", "er14_families"}


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in catalog.BASE:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def _cell(x) -> str:
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if str(x) in ("True", "False"):
        return str(x)
    if hasattr(x, "isoformat"):
        return pd.Timestamp(x).isoformat()
    try:
        return str(round(float(x), 6))
    except (TypeError, ValueError):
        return str(x)


def _rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple(map(_cell, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    got = QUERIES[name](spark, data).toPandas()
    assert len(got) or name in MAY_BE_EMPTY
    if name in ORACLES:
        want = duck.sql(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert _rows(got) == _rows(want)


def test_live_listing_agrees_with_the_model(spark, data):
    live = QUERIES["q01_category_listing_live"](spark, data).select("group_id", "listing_id")
    model = catalog.run(spark, data, "SELECT group_id, min_by(listing_id, (unit_price_cents, price_cents, supplier_id, canonical_id)) AS listing_id FROM listed_offer WHERE category ILIKE 'STANDARD%' GROUP BY group_id")
    assert live.join(model, ["group_id", "listing_id"], "left_anti").count() == 0


def test_entry(spark, data):
    assert registry.entry(spark, data).count() > 0

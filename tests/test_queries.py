"""Every query of the registry against its SQL in DuckDB on the smallest driver tables; those without SQL by what must hold."""

import math
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from tallyspark.plans import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the driver's tables are absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, (float, Decimal)):
        return "nan" if math.isnan(value) else f"{float(value):.9g}"
    if isinstance(value, (list, tuple)):
        return str([plain(x) for x in value])
    return value.replace(tzinfo=None).isoformat() if hasattr(value, "tzinfo") else str(value)


def rows(table, columns):
    return Counter(tuple(plain(r[c]) for c in columns) for r in table.to_pylist())


@pytest.mark.parametrize("name", list(registry.SQL))
def test_equals_sql(spark, duck, name):
    got, wanted = registry.QUERIES[name](spark, FOLDER).toArrow(), duck.execute(registry.SQL[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(wanted.column_names)
    assert rows(got, got.column_names) == rows(wanted, got.column_names)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_models_give_rows(spark, name):
    found = registry.QUERIES[name](spark, FOLDER).toArrow()
    assert found.num_rows and len(set(found.column_names)) == len(found.column_names)

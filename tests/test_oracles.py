"""Every core query against its DuckDB oracle on the smallest tables."""

import decimal
import math
import os

import duckdb
import pytest

from leafline.registry import core_oracles, core_queries

DATA = os.environ.get("LEAFLINE_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    held = duckdb.connect()
    held.execute("SET memory_limit='3GB'")
    for name in os.listdir(DATA):
        held.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return held


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}".rstrip("0").rstrip(".")
    if isinstance(value, decimal.Decimal):
        return f"{value:f}".rstrip("0").rstrip(".") if "." in f"{value:f}" else f"{value:f}"
    if isinstance(value, list | tuple):
        return [plain(x) for x in value]
    return str(value)


@pytest.mark.parametrize("name", sorted(core_oracles()))
def test_oracle(spark, con, name):
    found = core_queries()[name](spark, DATA)
    columns = sorted(found.columns)
    rows = sorted([plain(r[c]) for c in columns] for r in found.collect())
    cursor = con.execute(core_oracles()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert rows == sorted([plain(r[names.index(c)]) for c in columns] for r in cursor.fetchall())
    assert rows or name in {"missing_anti", "visibility_filters"}

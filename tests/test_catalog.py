"""Every catalogued query against its SQL, on the smallest tables."""

import math
import re
from pathlib import Path

import duckdb
import pytest

from mediaframe.plans import catalog, codec_queries, container_queries, inspect_queries, report_queries  # noqa: F401  (register their queries)

from .conftest import SMALL


def tidy(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    try:
        return f"{float(value):.9g}"
    except (TypeError, ValueError):
        return str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(tidy(r[k]) for k in order) for r in data)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows(spark, duck, name):
    got = catalog.QUERIES[name](spark, SMALL)
    want = duck.execute(catalog.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


def test_bytes_are_made_once(spark):
    """What is made of a row stands once in the plan, not once for each field that is read from it."""
    for name, sign, times in (("v07_dolby_config", "regexp_replace(", 2), ("p21_id3v1", "lpad(hex(", 2)):
        plan = catalog.QUERIES[name](spark, str(SMALL))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(sign) == times, (name, plan.count(sign))


def test_facts_are_dealt_as_files_are(spark, monkeypatch):
    """The tasks that group facts grow in number with the files, so that none of them grows."""
    monkeypatch.setattr(catalog, "DEALT", 25)
    n = catalog.tasks(spark, str(SMALL), "part")
    assert n == -(-catalog.table(spark, str(SMALL), "part").count() // 25) > 4
    for name in ("i02_inspect_matroska", "i03_inspect_library"):
        plan = catalog.QUERIES[name](spark, str(SMALL))._jdf.queryExecution().logical().toString()
        assert re.search(rf"RepartitionByExpression \[path#\d+\], {n}\b", plan), name

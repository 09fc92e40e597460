"""Registered queries against their SQL on the smallest tables."""

import math
import re
from collections import Counter

import duckdb
import pytest

from tidegate.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, data, duck, name):
    df = registry.queries()[name](spark, data)
    got = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    want = Counter(tuple(plain(r[i]) for i in order) for r in got.fetchall())
    assert Counter(tuple(map(plain, r)) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_gives_rows(spark, data, name):
    assert registry.queries()[name](spark, data).count() > 0


def test_nothing_imports_the_llm_subpackage():
    from .conftest import ROOT

    for path in (ROOT / "tidegate").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"tidegate\.llm|from \.+llm", path.read_text()), path

"""Every registered query runs at the smallest scale; those with SQL agree with it."""

from __future__ import annotations

import re

import pytest
from conftest import SF
from oracle import compare, connect

from __spark_entry__ import entry, oracle_sql, queries


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    df = queries()[name](spark, SF)
    if name in oracle_sql():
        assert compare(df, con, oracle_sql()[name]) == []
    else:
        assert df.count() >= 0 and df.columns


def test_entry(spark):
    assert entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(oracle_sql()) <= set(queries())


def test_inventory_is_covered():
    """Every operator id has at least one query."""
    counts = {"s": 15, "p": 26, "j": 8, "a": 23, "w": 19, "r": 8, "d": 8, "g": 7, "m": 13, "o": 5, "e": 8}
    have = {m.group(1) for n in queries() if (m := re.match(r"([a-z]\d+)", n))}
    wanted = {f"{p}{i}" for p, n in counts.items() for i in range(1, n + 1)}
    assert wanted - have == set()

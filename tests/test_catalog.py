"""Every operator with SQL against the oracle engine on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from corpusflow.plans import registry

registry.load()
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_operator_equals_oracle(spark, duck, name):
    got = registry.QUERIES[name](spark, FOLDER)
    have = sorted(repr([plain(v) for _, v in sorted(r.asDict().items())]) for r in got.collect())
    ran = duck.execute(registry.ORACLES[name])
    names = [c[0] for c in ran.description]
    want = sorted(repr([plain(v) for _, v in sorted(zip(names, r))]) for r in ran.fetchall())
    assert sorted(names) == sorted(got.columns)
    assert have == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_other_queries_run(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).count() > 0


def test_no_cartesian_growth():
    """Cross joins are with literal tables or one-row inputs only."""
    from corpusflow.plans.catalog import OPERATORS

    for op in OPERATORS.values():
        for part in op.sql.split("CROSS JOIN ")[1:]:
            assert part.startswith(("{destinations}", "c", "p ")), op.name

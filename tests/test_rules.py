"""Each case of tests/rules against its SQL."""

import datetime as dt

import duckdb
import pytest

from rules import base, canonical, dataset, ingestion, matching  # noqa: F401  (modules add their cases when imported)


def plain(v):
    return round(v, 9) if isinstance(v, float) else v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v


@pytest.mark.parametrize("name", sorted(base.QUERIES))
def test_rule(spark, name):
    want = duckdb.connect().execute(base.ORACLES[name])
    names = [d[0] for d in want.description]
    rows = base.QUERIES[name](spark, "").select(*names).collect()
    key = lambda r: repr(tuple(map(plain, r)))
    assert sorted(map(key, rows)) == sorted(map(key, want.fetchall()))

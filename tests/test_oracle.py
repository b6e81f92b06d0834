"""Every registered query against its DuckDB oracle on the smallest tables."""

import hashlib
import math

import pandas as pd
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from elotrail.registry import REGISTRY
from tests.conftest import SF_SMALL

ORACLES = oracle_sql()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None).isoformat()
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def digest(pdf):
    cols = sorted(pdf.columns)
    rows = sorted(repr(tuple(_norm(r[c]) for c in cols)) for r in pdf.to_dict("records"))
    return len(rows), cols, hashlib.sha1("\n".join(rows).encode()).hexdigest()


def test_every_query_has_an_oracle():
    """The engine's own queries; those of the optional part have tests of their own."""
    assert set(REGISTRY) <= set(ORACLES) and set(REGISTRY) <= set(queries())


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_matches_oracle(spark, duck, name):
    got = queries()[name](spark, SF_SMALL).toPandas()
    want = duck.execute(ORACLES[name]).df()
    assert digest(got) == digest(want)


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.count() > 0
    assert {"band", "months_to_gain"} <= set(df.columns)

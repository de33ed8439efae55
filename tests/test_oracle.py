"""Every registered query against its independent DuckDB formulation (sf0.001)."""

import math

import pytest

import __spark_entry__ as E
from shelfscope import catalog
from tests.conftest import SMALL

QUERIES = {n: q for n, q in E.queries().items() if n in catalog.REGISTRY}
ORACLE = E.oracle_sql()


def _canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    return repr(float(v)) if isinstance(v, float) else str(v)


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_canon(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)),
                        key=lambda t: tuple("" if x is None else x for x in t))


def test_every_query_has_an_oracle():
    missing = sorted(set(QUERIES) - set(ORACLE))
    assert missing == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    sp = QUERIES[name](spark, SMALL).toPandas()
    dk = duck.execute(ORACLE[name]).df()
    c1, r1 = _rows(sp)
    c2, r2 = _rows(dk)
    assert c1 == c2
    assert len(r1) == len(r2)
    assert r1 == r2


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "hhi_segment" in df.columns

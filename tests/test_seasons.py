"""Apportionment between calendars: exact day weights, totals preserved."""

import datetime as dt
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shelfscope.functions import calendar as C
from shelfscope.operators.overlap import apportioned, covered_days, period_overlap

DAY = dt.timedelta(1)


def month(d):
    return f"{d.year:04d}M{d.month:02d}"


def fiscal(d):
    fy = d.year - (d < dt.date(d.year, 4, 1))
    return f"{fy:04d}P{min(13, (d - dt.date(fy, 4, 1)).days // 28 + 1):02d}"


def all_days(first, last):
    while first <= last:
        yield first
        first += DAY


DAYS = list(all_days(dt.date(1999, 1, 1), dt.date(2004, 12, 31)))
NAMES = {"M": month, "P": fiscal}


def whole(kind, name):
    """The labels all of whose days lie in DAYS."""
    ends = {NAMES[kind](DAYS[0]), NAMES[kind](DAYS[-1])}
    return name not in ends or kind == "M"


@pytest.mark.parametrize("target", ["M", "P"])
def test_overlap_counts_days(spark, target):
    want = Counter()
    for source in NAMES.values():
        want += Counter((source(d), NAMES[target](d)) for d in DAYS)
    labels = sorted({a for a, _ in want if whole(a[4], a)})
    got = period_overlap(spark.createDataFrame([(x,) for x in labels], "period_code string"), target).collect()
    assert {(r["period_code"], r["season_code"]): r["days"] for r in got} == {
        k: n for k, n in want.items() if whole(k[0][4], k[0])}
    for label in labels:
        rows = sorted((r for r in got if r["period_code"] == label), key=lambda r: r["season_code"])
        assert sum(r["days"] for r in rows) == rows[0]["period_days"]
        assert [r["days_before"] for r in rows] == [sum(x["days"] for x in rows[:i]) for i in range(len(rows))]


def test_label_bounds(spark):
    rows = spark.createDataFrame([("2000M02",), ("2000P01",), ("2000P13",), ("1999P13",)], "x string").select(
        "x", C.label_start("x").alias("a"), C.label_end("x").alias("b")).collect()
    assert [(r["x"], str(r["a"]), str(r["b"])) for r in rows] == [
        ("2000M02", "2000-02-01", "2000-03-01"), ("2000P01", "2000-04-01", "2000-04-29"),
        ("2000P13", "2001-03-03", "2001-04-01"), ("1999P13", "2000-03-02", "2000-04-01")]
    n = spark.createDataFrame([(x,) for x in ("2000M12", "2001M01")], "x string").select(
        C.ordinal_label(C.label_ordinal("x"), "M").alias("y")).collect()
    assert [r["y"] for r in n] == ["2000M12", "2001M01"]


def cut(units, days, period):
    q, r = divmod(abs(units) * days, period)
    return (q + (2 * r >= period)) * (1 if units >= 0 else -1)


@pytest.mark.parametrize("target", ["M", "P"])
def test_parts_are_exact_and_totals_stay(spark, target):
    import random
    r = random.Random(5)
    rows = [("a", month(dt.date(2000, m, 1)), Decimal(r.randint(-10 ** 7, 10 ** 9)).scaleb(-4)) for m in range(1, 13) for _ in range(3)]
    rows += [("b", f"2000P{p:02d}", Decimal(r.randint(0, 99)).scaleb(-4)) for p in range(1, 14)]
    rows += [("c", "2000M01", None), ("c", "2000M03", Decimal("0.0001")), ("c", None, Decimal(5)), ("c", "2000M13", Decimal(7)),
             ("c", "junk", Decimal(7)), (None, "2000M05", Decimal(10))]
    sales = spark.createDataFrame(rows, "k string, period_code string, v decimal(18,4)")
    got = {(x["k"], x["season_code"]): x["v"] for x in apportioned(sales, target, ("v",), ("k",)).collect()}
    sums, want = {}, {}
    for k, label, v in rows:
        if label and label not in ("2000M13", "junk"):
            old = sums.get((k, label))
            sums[k, label] = v if old is None else old if v is None else old + v
    for (k, label), v in sums.items():
        days = [d for d in DAYS if NAMES[label[4]](d) == label]
        for name in sorted({NAMES[target](d) for d in days}):
            mine = [i for i, d in enumerate(days) if NAMES[target](d) == name]
            units = None if v is None else int(v.scaleb(4))
            part = None if v is None else cut(units, mine[-1] + 1, len(days)) - cut(units, mine[0], len(days))
            old = want.get((k, name))
            want[k, name] = part if old is None else old if part is None else old + part
    assert {k: None if v is None else int(v.scaleb(4)) for k, v in got.items()} == want
    for k in "ab":
        assert sum(v for (x, _), v in got.items() if x == k) == sum(v for x, _, v in rows if x == k)


def test_covered_days(spark):
    sales = spark.createDataFrame([("a", "2000M04"), ("a", "2000M04"), ("a", "2000M05"), ("b", "2000P01")], "k string, period_code string")
    got = {(r["k"], r["season_code"]): (r["covered_days"], r["season_days"]) for r in covered_days(sales, "P", ("k",)).collect()}
    assert got == {("a", "2000P01"): (28, 28), ("a", "2000P02"): (28, 28), ("a", "2000P03"): (5, 28), ("b", "2000P01"): (28, 28)}


def test_season_totals_are_those_of_the_view(spark):
    from shelfscope.queries import _etl_view
    from tests.conftest import SMALL
    view = _etl_view(spark, SMALL)
    total = F.sum("sale_9l_case").alias("v"), F.sum("revenue").alias("r")
    whole = {x["product_code"]: (x["v"], x["r"]) for x in view.groupBy("product_code").agg(*total).collect()}
    parts = apportioned(view, "P", ("sale_9l_case", "revenue"), ("product_code",))
    assert {x["product_code"]: (x["v"], x["r"]) for x in parts.groupBy("product_code").agg(*total).collect()} == whole

"""Sums by period rolled forward, and deliveries merged into a table."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from shelfscope.params import DEFAULT
from shelfscope.plans import outlook
from shelfscope.sources import merge, proxy
from shelfscope.sources import rollup as RU
from tests.conftest import SMALL


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def stored(spark):
    path = tempfile.mkdtemp(prefix="shelfscope-rollup-") + "/rollup"
    RU.write_rollup(RU.period_rollup(proxy.calc_sales(spark, SMALL)), path)
    return path


def state_at(spark, path, anchor):
    labels = [x for year in RU.year_labels({"M": anchor}) for x in year]
    return RU.year_state(RU.read_rollup(spark, path, labels), {"M": anchor})


@pytest.mark.parametrize("old, new", [("2001M09", "2001M10"), ("2001M10", "2001M10"), ("2000M01", "2001M10"), ("1999M02", "2001M10"),
                                      ("2001M10", "2001M07")])
def test_rolled_state_equals_a_new_one(spark, stored, old, new):
    state = state_at(spark, stored, old)
    got = RU.rolled_forward(state, RU.read_rollup(spark, stored), {"M": old}, {"M": new})
    want = state_at(spark, stored, new)
    assert rows_of(got) == rows_of(want) and got.columns == want.columns


def test_moved_labels_of_both_calendars():
    moved = RU.moved_labels({"M": "2001M09", "P": "2001P08"}, {"M": "2001M10", "P": "2001P09"})
    assert moved == [(["2000M10", "2000P09"], "ly", 1), (["2001M10", "2001P09"], "ty", 1),
                     (["1999M10", "1999P09"], "ly", -1), (["2000M10", "2000P09"], "ty", -1)]


def test_base_from_the_state_equals_the_full_scan_and_reads_no_fact(spark, stored):
    state = RU.rolled_forward(state_at(spark, stored, "2001M09"), RU.read_rollup(spark, stored), {"M": "2001M09"}, {"M": "2001M10"})
    varietals = proxy.varietal_dim(spark, SMALL)
    base = RU.base_of_state(state, varietals, DEFAULT)
    want = outlook.brand_base(proxy.calc_sales(spark, SMALL, window=True), proxy.report_periods(spark), varietals, DEFAULT)
    assert rows_of(base, *want.columns) == rows_of(want)
    plan = base._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "period_code" in plan
    delta = RU.read_rollup(spark, stored).where(F.col("period_code").isin("1999M10", "2000M10", "2001M10"))
    assert "PartitionFilters: [period_code" in delta._jdf.queryExecution().executedPlan().toString()


def test_a_delivery_replaces_its_own_periods_only(spark):
    path = tempfile.mkdtemp(prefix="shelfscope-rollup-") + "/rollup"
    schema = "province_code string, varietal string, unit_size int, brand string, origin string, period_code string, sale_9l_case decimal(18,4), revenue decimal(28,4)"

    def deliver(*rows):
        RU.write_rollup(RU.period_rollup(spark.createDataFrame([("ON", "Red", 750, b, "USA", p, v, v) for b, p, v in rows], schema)), path)

    from decimal import Decimal as D
    deliver(("a", "2000M01", D(1)), ("a", "2000M01", D(2)), ("b", "2000M02", D(5)))
    deliver(("a", "2000M02", D(7)))
    got = rows_of(RU.read_rollup(spark, path), "brand", "period_code", "sale_9l_case", "lines")
    assert got == [("a", "2000M01", D("3.0000"), 2), ("a", "2000M02", D("7.0000"), 1)]


KEYS, PARTS = ("province_code", "global_code", "sale_period"), ("province_code", "sale_period")
SALES = "province_code string, global_code string, sale_period string, sale_actual_cases double"


def sales(spark, *rows):
    return spark.createDataFrame(rows, SALES)


def test_merge_replaces_keys_and_carries_the_rest(spark):
    path = tempfile.mkdtemp(prefix="shelfscope-merge-") + "/sales"
    r = random.Random(1)
    held = {}
    for _ in range(4):
        delivered = {(p, f"{p}{r.randint(0, 20)}", f"2000M0{r.randint(1, 4)}"): float(r.randint(0, 99)) for p in ("ON", "QC") for _ in range(12)}
        merge.merge_partitions(sales(spark, *[(*k, v) for k, v in delivered.items()]), path, KEYS, PARTS)
        held |= delivered
        assert {tuple(x[c] for c in KEYS): x["sale_actual_cases"] for x in spark.read.parquet(path).collect()} == held
        assert spark.read.parquet(path).count() == len(held)


def test_merge_again_changes_nothing_and_leaves_other_partitions(spark):
    path = tempfile.mkdtemp(prefix="shelfscope-merge-") + "/sales"
    merge.merge_partitions(sales(spark, ("ON", "ON1", "2000M01", 1.0), ("QC", "QC1", "2000M01", 2.0), ("ON", None, "2000M01", 9.0)), path, KEYS, PARTS)
    before = set(os.listdir(f"{path}/province_code=QC/sale_period=2000M01"))
    again = sales(spark, ("ON", "ON1", "2000M01", None), ("ON", None, "2000M01", 8.0))
    for _ in range(2):
        merge.merge_partitions(again, path, KEYS, PARTS)
        assert rows_of(spark.read.parquet(path), *KEYS, "sale_actual_cases") == [
            ("ON", "ON1", "2000M01", None), ("ON", None, "2000M01", 8.0), ("QC", "QC1", "2000M01", 2.0)]
    assert set(os.listdir(f"{path}/province_code=QC/sale_period=2000M01")) == before
    with pytest.raises(ValueError):
        merge.merge_partitions(again, path, ("global_code",), PARTS)


def test_a_lost_merge_is_finished_by_the_next(spark):
    path = tempfile.mkdtemp(prefix="shelfscope-merge-") + "/sales"
    merge.merge_partitions(sales(spark, ("ON", "ON1", "2000M01", 1.0), ("ON", "ON2", "2000M01", 2.0)), path, KEYS, PARTS)
    # lost after staging, with the partition already gone from the table
    sales(spark, ("ON", "ON1", "2000M01", 5.0), ("ON", "ON2", "2000M01", 2.0)).write.mode("overwrite").parquet(f"{path}__pending")
    for f in os.listdir(f"{path}/province_code=ON/sale_period=2000M01"):
        os.remove(f"{path}/province_code=ON/sale_period=2000M01/{f}")
    merge.merge_partitions(sales(spark, ("ON", "ON3", "2000M01", 3.0)), path, KEYS, PARTS)
    assert rows_of(spark.read.parquet(path), "global_code", "sale_actual_cases") == [("ON1", 5.0), ("ON2", 2.0), ("ON3", 3.0)]


def test_latest_row_of_a_key(spark):
    df = spark.createDataFrame([("a", 1, None, 3), ("a", 2, "x", 1), ("a", 2, "y", 2), (None, 1, "z", 1)], "k string, t int, v string, u int")
    assert rows_of(merge.latest(df, ("k",), ("t", "u")), "k", "v") == [("a", "y"), (None, "z")]

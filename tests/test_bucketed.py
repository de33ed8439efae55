"""Sales and products stored by the same hash of the product."""

import uuid

import pytest

from shelfscope.params import DEFAULT
from shelfscope.plans import flagship, top_sku
from shelfscope.sources import proxy
from shelfscope.sources.warehouse import attach_bucketed, open_bucketed, write_bucketed
from tests.conftest import SMALL

BUCKETS = 4


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("it's bucketed"))
    names = [f"{n}_{uuid.uuid4().hex}" for n in ("sales", "products")]
    write_bucketed(proxy.calc_sales(spark, SMALL), proxy.products(spark, SMALL), *names, path, BUCKETS)
    yield (*names, path)
    for n in names:
        spark.sql(f"DROP TABLE IF EXISTS {n}")


@pytest.fixture
def shuffled_joins(spark):
    """As on tables too large to be broadcast; the plan as it is without runtime changes."""
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("base", [flagship.flagship_base, top_sku.top_sku_base])
def test_sku_base_shuffles_neither_side(spark, store, shuffled_joins, base):
    periods = proxy.report_periods(spark)
    sales, products = open_bucketed(spark, *store[:2], proxy.report_period_labels())
    plan = plan_of(base(sales, periods, products, DEFAULT))
    exchanges = [x for x in plan.splitlines() if "Exchange" in x]
    assert exchanges and all("BroadcastExchange" in x for x in exchanges), plan  # the period dim alone
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    direct = plan_of(base(proxy.calc_sales(spark, SMALL, window=True), periods, proxy.products(spark, SMALL), DEFAULT))
    assert "Exchange hashpartitioning" in direct


def test_report_from_the_store_equals_the_direct_one(spark, store):
    periods = proxy.report_periods(spark)
    sales, products = open_bucketed(spark, *store[:2], proxy.report_period_labels())
    want = flagship.flagship_pricing(proxy.calc_sales(spark, SMALL, window=True), periods, proxy.products(spark, SMALL), DEFAULT)
    assert rows_of(flagship.flagship_pricing(sales, periods, products, DEFAULT)) == rows_of(want)
    assert want.count() > 0


def test_another_session_attaches_the_files(spark, store, shuffled_joins):
    names = [f"{n}_again" for n in store[:2]]
    view, dim = proxy.calc_sales(spark, SMALL), proxy.products(spark, SMALL)
    attach_bucketed(spark, *names, store[2], view, dim, BUCKETS)
    try:
        for mine, first in zip(open_bucketed(spark, *names), open_bucketed(spark, *store[:2]), strict=True):
            assert rows_of(mine.select(*first.columns)) == rows_of(first)
        sales, products = open_bucketed(spark, *names)
        plan = plan_of(sales.join(products, sales.product_code == products.global_code))
        assert "Bucketed: true" in plan and "Exchange" not in plan
    finally:
        for n in names:
            spark.sql(f"DROP TABLE IF EXISTS {n}")

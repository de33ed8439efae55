"""Physical-plan properties that matter at scale."""

import pytest

import __spark_entry__ as E
from shelfscope import catalog
from shelfscope.params import DEFAULT
from shelfscope.plans import outlook, top_sku
from shelfscope.sources import proxy
from tests.conftest import SMALL

QUERIES = {n: q for n, q in E.queries().items() if n in catalog.REGISTRY}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_udf_in_any_plan(spark, name):
    p = plan_of(QUERIES[name](spark, SMALL))
    for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF"):
        assert node not in p, f"{name} plans {node}"


def test_window_filter_reaches_parquet(spark):
    df = outlook.market_outlook(proxy.calc_sales(spark, SMALL, window=True), proxy.report_periods(spark),
                                proxy.varietal_dim(spark, SMALL), DEFAULT)
    p = plan_of(df)
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in p


def test_lineitem_scan_is_pruned(spark):
    df = outlook.market_outlook(proxy.calc_sales(spark, SMALL, window=True), proxy.report_periods(spark),
                                proxy.varietal_dim(spark, SMALL), DEFAULT)
    p = plan_of(df)
    schemas = [line for line in p.splitlines() if "lineitem.parquet" in line or "ReadSchema" in line]
    li = [s for s in p.split("FileScan parquet") if "l_shipdate" in s and "ReadSchema" in s]
    assert li, schemas
    read_schema = li[0].split("ReadSchema: ")[1].split("\n")[0]
    assert "l_tax" not in read_schema and "l_returnflag" not in read_schema


def test_outlook_aggregates_are_fused(spark):
    """Concentration and performance come from one aggregate: no join after the
    brand-level aggregate."""
    df = outlook.market_outlook(proxy.calc_sales(spark, SMALL, window=True), proxy.report_periods(spark),
                                proxy.varietal_dim(spark, SMALL), DEFAULT)
    logical = df._jdf.queryExecution().optimizedPlan().toString()
    top = logical.split("Aggregate [province_code")[0]
    assert "Join" not in top


@pytest.fixture
def static_plans(spark):
    """Plans as at scale: no adaptive node around them, no broadcast of a growing side."""
    keep = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    for k, v in keep.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_top_n_limits_below_the_exchange(spark, static_plans):
    p = DEFAULT.with_(unit_size=750, varietal="LARGE", top_n=3)
    lines = plan_of(top_sku.top_sku(proxy.calc_sales(spark, SMALL), proxy.report_periods(spark), proxy.products(spark, SMALL), p)
                    ).splitlines()
    partial = next(i for i, x in enumerate(lines) if "WindowGroupLimit" in x and "Partial" in x)
    final = next(i for i, x in enumerate(lines) if "WindowGroupLimit" in x and "Final" in x)
    between = [x for x in lines[final:partial] if "Exchange hashpartitioning(province_code" in x]
    assert final < partial and between


@pytest.mark.parametrize("name", ["ins_portfolio_gap", "ins_per_capita", "market_outlook", "flagship_pricing", "varietal_benchmark"])
def test_the_fact_is_scanned_once(spark, static_plans, name):
    p = plan_of(QUERIES[name](spark, SMALL))
    scans = [x for x in p.splitlines() if "FileScan parquet" in x and "l_quantity" in x]
    assert len(scans) == 1, p


def test_flagship_windows_of_segments_see_flagship_rows_only(spark, static_plans):
    p = plan_of(QUERIES["flagship_sku"](spark, SMALL)).splitlines()
    segment = [i for i, x in enumerate(p) if "Exchange hashpartitioning(province_code" in x and "brand" not in x.split(", 4")[0]]
    rank = [i for i, x in enumerate(p) if "Filter" in x and "sku_rank_by_volume" in x]
    assert segment and rank and segment[0] < rank[0]


def test_no_action_while_a_plan_is_built(spark):
    proxy.varietal_dim(spark, SMALL)  # schemas are remembered
    QUERIES["filter_portfolio"](spark, SMALL)
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup())
    for name in ("market_outlook", "filter_portfolio", "top3_sku", "ins_national_rank"):
        QUERIES[name](spark, SMALL)
    assert len(tracker.getJobIdsForGroup()) == before

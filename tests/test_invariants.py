"""Property checks on report outputs (sf0.01)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfscope.params import DEFAULT
from shelfscope.plans import flagship, forecast, outlook
from shelfscope.sources import proxy
from tests.conftest import MEDIUM

ARCHETYPES = {f"{m}{' ' if m else ''}{p}" for m in ("Expanding", "Contracting", "Steady", "")
              for p in ("Leader", "Core", "Challenger", "Niche", "Pipeline")}


@pytest.fixture(scope="module")
def seg(spark):
    base = outlook.brand_base(proxy.calc_sales(spark, MEDIUM, window=True), proxy.report_periods(spark),
                              proxy.varietal_dim(spark, MEDIUM), DEFAULT)
    return outlook.ranked(base).toPandas()


def test_shares_sum_to_100(seg):
    for col in ("market_share_ly", "market_share_ty"):
        sums = seg.groupby(["province_code", "varietal"])[col].sum()
        assert all(abs(s - 100.0) < 1e-6 or abs(s) < 1e-9 for s in sums)


def test_cumulative_share_monotone_and_ends_at_100(seg):
    for _, g in seg.groupby(["province_code", "varietal"]):
        g = g.sort_values("rank_by_sale")
        cum = g["cum_market_share_ty"].to_numpy()
        assert np.all(np.diff(cum) >= -1e-9)
        assert abs(cum[-1] - 100.0) < 1e-6
        assert list(g["rank_by_sale"]) == list(range(1, len(g) + 1))


def test_outlook_bounds(spark):
    df = outlook.market_outlook(proxy.calc_sales(spark, MEDIUM, window=True), proxy.report_periods(spark),
                                proxy.varietal_dim(spark, MEDIUM), DEFAULT).toPandas()
    assert (df.cr3 <= df.cr5 + 1e-9).all() and (df.cr5 <= df.cr10 + 1e-9).all() and (df.cr10 <= 100.0).all()
    assert ((df.hhi_ty >= 10000.0 / df.total_active_brands - 1) & (df.hhi_ty <= 10000.0)).all()
    assert set(df.focal_archetype_position) <= ARCHETYPES
    total_change = (df.tier_1_market_share_change + df.tier_2_market_share_change
                    + df.tier_3_market_share_change + df.focal_market_share_growth)
    assert (total_change.abs() < 1e-6).all()


def test_flagship_cut_and_tiers(spark):
    df = flagship.flagship_pricing(proxy.calc_sales(spark, MEDIUM, window=True), proxy.report_periods(spark),
                                   proxy.products(spark, MEDIUM), DEFAULT).toPandas()
    for _, g in df.groupby(["province_code", "varietal", "unit_size"]):
        g = g.sort_values("brand_rank_by_volume")
        assert list(g.brand_rank_by_volume) == list(range(1, len(g) + 1))
    assert set(df.brand_tier) <= {1, 2, 3}


def test_fwl_slope_equals_dummy_least_squares(spark):
    from shelfscope.sources.tables import read_table

    li = read_table(spark, MEDIUM, "lineitem", ["l_partkey", "l_quantity", "l_discount", "l_shipdate"])
    part = read_table(spark, MEDIUM, "part", ["p_partkey", "p_type"])
    pts = forecast.series_points(li.join(part, li.l_partkey == part.p_partkey), "p_type", "l_shipdate",
                                 "l_quantity", "l_discount", 5)
    fit = {r.series: r.promo_slope for r in forecast.ols_fit(pts).collect()}
    pdf = pts.toPandas()
    for series, g in pdf.groupby("series"):
        seasons = sorted(g.season.unique())
        X = np.column_stack([(g.season == s).astype(float) for s in seasons] + [g.promo.to_numpy()])
        coef, *_ = np.linalg.lstsq(X, g.y.to_numpy(), rcond=None)
        expected = coef[-1] if np.linalg.matrix_rank(X) == X.shape[1] else 0.0
        assert abs(fit[series] - expected) < 1e-6 * max(1.0, abs(expected))


def test_melt_preserves_totals(spark):
    from shelfscope.plans import etl as ETL
    from shelfscope.queries import _enriched, _spec

    e = _enriched(spark, MEDIUM, "M")
    spec = _spec("M")
    long = ETL.sales_of(e, spec)
    assert long.count() == e.count() * len(spec.period_labels)
    wide_total = e.select(F.sum(F.aggregate(F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in spec.period_labels]),
                                            F.lit(0.0), lambda a, x: a + x))).first()[0]
    long_total = long.select(F.sum("sale_actual_cases")).first()[0]
    assert abs(wide_total - long_total) < 1e-6

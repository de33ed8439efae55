"""Market outlook report: concentration, tiers and the focal brand's position per
(province, varietal) market.

Physical shape: one fact scan + joins, one hash aggregate to brand grain (partial
aggregation map-side), then a single exchange on (province_code, varietal) shared by
every window and by the final aggregate. Concentration and performance measures
come from one fused ``groupBy`` -- no self-join of two aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.functions.numeric import yoy2
from shelfscope.functions.text import ieq, ine
from shelfscope.operators import measures as M
from shelfscope.operators.conform import market_filter, with_portfolio, with_relative_year
from shelfscope.operators.position import archetype, hhi_segment, momentum, position
from shelfscope.params import MarketParams

MARKET = ["province_code", "varietal"]


def brand_base(sales: DataFrame, periods: DataFrame, varietals: DataFrame, p: MarketParams) -> DataFrame:
    """LY/TY volume and revenue by (province, varietal, brand) for the home origin's
    portfolio varietals plus the exception pair. Keys are compared as match keys.

    Sales that carry ``in_portfolio`` (attached to the products before the fact join) are
    filtered and aggregated at once. Otherwise the flag comes from the varietal dim, and
    joining that to fact rows would put a low-cardinality key (varietal) on a fact-side
    shuffle whenever the dim is not broadcast, which Spark would reuse for the aggregate:
    a handful of tasks for the whole fact. So the fact is aggregated first, keyed also by
    which filter arm each row satisfies; the dim is joined at brand grain, the portfolio
    condition applied there, and the arms re-aggregated.
    """
    s = with_relative_year(sales, periods)
    if p.unit_size is not None:
        s = s.filter(F.col("unit_size") == p.unit_size)
    measures = {
        "sale_vol_ly": ("sale_9l_case", p.last_year),
        "sale_vol_ty": ("sale_9l_case", p.this_year),
        "revenue_ly": ("revenue", p.last_year),
        "revenue_ty": ("revenue", p.this_year),
    }
    if "in_portfolio" in sales.columns:
        s = s.filter(market_filter(p.origin, p.exception_varietal, p.exception_origin, "in_portfolio"))
        return M.rolling_year(s, MARKET + ["brand"], measures)
    home = ieq("origin", p.origin)
    exc = ieq("varietal", p.exception_varietal) & ieq("origin", p.exception_origin)
    s = (s.filter(market_filter(p.origin, p.exception_varietal, p.exception_origin))
          .withColumn("__home", home).withColumn("__exc", exc))
    arms = M.rolling_year(s, MARKET + ["brand", "__home", "__exc"], measures)
    kept = with_portfolio(arms, varietals).filter((F.col("__home") & (F.col("in_portfolio") == 1)) | F.col("__exc"))
    return kept.groupBy(*MARKET, "brand").agg(*[F.sum(m).alias(m) for m in measures])


def brand_order():
    return M.order_desc("sale_vol_ty", "revenue_ty", tiebreak=("brand",))


def ranked(base: DataFrame) -> DataFrame:
    """Shares, cumulative TY share, rank by sales."""
    o = brand_order()
    return base.select(
        "*",
        M.share("sale_vol_ly", MARKET).alias("market_share_ly"),
        M.share("sale_vol_ty", MARKET).alias("market_share_ty"),
        M.cum_share("sale_vol_ty", MARKET, o).alias("cum_market_share_ty"),
        M.row_number(MARKET, o).alias("rank_by_sale"),
    )


def segmented(rk: DataFrame, p: MarketParams) -> DataFrame:
    """Share growth and tier from the previous brand's cumulative share."""
    lag = M.lagged("cum_market_share_ty", MARKET, brand_order())
    return rk.select(
        *MARKET, "brand", "sale_vol_ly", "sale_vol_ty", "revenue_ly", "revenue_ty",
        "market_share_ly", "market_share_ty",
        (F.col("market_share_ty") - F.col("market_share_ly")).alias("market_share_growth"),
        "rank_by_sale",
        M.tier(lag, p.tier1_threshold, p.tier2_threshold).alias("tier"),
    )


def market_kpis(seg: DataFrame, p: MarketParams) -> DataFrame:
    """J7-J17 in one aggregate: concentration, market YoY, focal KPIs, tier KPIs."""
    return seg.groupBy(*MARKET).agg(*_kpi_aggs(p.focal_brand))


def _kpi_aggs(fb: str) -> list:
    """The aggregate expressions of ``market_kpis``."""
    is_focal = ieq("brand", fb)
    ty, ly = F.col("sale_vol_ty"), F.col("sale_vol_ly")
    aggs = [
        M.hhi("market_share_ly").alias("hhi_ly"),
        M.hhi("market_share_ty").alias("hhi_ty"),
        *[M.concentration_ratio(k, "rank_by_sale", "sale_vol_ty").alias(f"cr{k}") for k in (3, 5, 10)],
        F.sum(ty).alias("total_market_sale_ty"),
        F.count("brand").alias("total_active_brands"),
        yoy2(F.sum(ty), F.sum(ly)).alias("market_yoy_change"),
        M.at_entity(is_focal, "rank_by_sale").alias("focal_rank_by_volume"),
        M.at_entity(is_focal, "tier").alias("focal_tier_by_volume"),
        F.coalesce(M.sum_when(is_focal, ty), F.lit(0)).alias("focal_total_sale_ty"),
        yoy2(M.sum_when(is_focal, ty), M.sum_when(is_focal, ly)).alias("focal_yoy_sale_change"),
        M.at_entity(is_focal, "market_share_ly", "sum", 0.0).alias("focal_market_share_ly"),
        M.at_entity(is_focal, "market_share_ty", "sum", 0.0).alias("focal_market_share_ty"),
        M.at_entity(is_focal, "market_share_growth", "sum", 0.0).alias("focal_market_share_growth"),
    ]
    for t in (1, 2, 3):
        cond = (F.col("tier") == t) & ine("brand", fb)
        aggs.append(yoy2(M.sum_when(cond, ty), M.sum_when(cond, ly)).alias(f"tier_{t}_yoy_change"))
    for t in (1, 2, 3):
        cond = (F.col("tier") == t) & ine("brand", fb)
        aggs.append((M.at_entity(cond, "market_share_ty", "sum", 0.0)
                     - M.at_entity(cond, "market_share_ly", "sum", 0.0)).alias(f"tier_{t}_market_share_change"))
    for t in (1, 2, 3):
        cond = (F.col("tier") == t) & ine("brand", fb)
        aggs.append(M.count_when(cond, ty).alias(f"tier_{t}_brands_count"))
    return aggs


OUTLOOK_COLUMNS = [
    "province_code", "varietal", "hhi_ly", "hhi_ty", "hhi_segment", "cr3", "cr5", "cr10",
    "total_market_sale_ty", "total_active_brands", "market_yoy_change",
    "focal_rank_by_volume", "focal_tier_by_volume", "focal_archetype_position",
    "focal_archetype_1st_part", "focal_archetype_2nd_part", "focal_total_sale_ty",
    "focal_yoy_sale_change", "focal_market_share_ly", "focal_market_share_ty",
    "focal_market_share_growth",
    "tier_1_yoy_change", "tier_2_yoy_change", "tier_3_yoy_change",
    "tier_1_market_share_change", "tier_2_market_share_change", "tier_3_market_share_change",
    "tier_1_brands_count", "tier_2_brands_count", "tier_3_brands_count",
]


def positioned(kpis: DataFrame) -> DataFrame:
    """HHI segment and the focal brand's archetype."""
    y, m, g = "focal_yoy_sale_change", "market_yoy_change", "focal_market_share_growth"
    r, t = "focal_rank_by_volume", "focal_tier_by_volume"
    return kpis.select(
        "*",
        hhi_segment("hhi_ty").alias("hhi_segment"),
        archetype(y, m, g, r, t).alias("focal_archetype_position"),
        momentum(y, m, g).alias("focal_archetype_1st_part"),
        position(r, t).alias("focal_archetype_2nd_part"),
    ).select(*OUTLOOK_COLUMNS)


def market_outlook(sales: DataFrame, periods: DataFrame, varietals: DataFrame, p: MarketParams) -> DataFrame:
    """The full report, one row per (province, varietal) market."""
    seg = segmented(ranked(brand_base(sales, periods, varietals, p)), p)
    return positioned(market_kpis(seg, p))

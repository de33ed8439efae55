"""Varietal benchmark report: per (province, varietal) -- varietal performance, top
origin, home-origin statistics, market leader over all origins, leader within the
home origin and the focal brand's standing there.

The brand-grain base aggregate feeds three consumers. They are written so the
plan below the base aggregate is identical for all of them (the home-origin
consumer marks home rows with a flag instead of filtering below the aggregate),
which lets Spark reuse one shuffle of the base instead of re-scanning the fact
table per consumer. Everything after the base runs on dimension-bounded rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.functions.numeric import yoy
from shelfscope.functions.text import ieq
from shelfscope.operators import measures as M
from shelfscope.operators.conform import with_relative_year
from shelfscope.params import MarketParams

MARKET = ["province_code", "varietal"]


def base(sales: DataFrame, periods: DataFrame, p: MarketParams, unit_size: int = 750) -> DataFrame:
    """LY/TY volume by (province, varietal, origin, brand) for one format."""
    s = with_relative_year(sales, periods)
    s = s.filter(F.col("unit_size") == F.lit(unit_size))
    return M.rolling_year(s, MARKET + ["origin", "brand"], {
        "sale_ly": ("sale_9l_case", p.last_year), "sale_ty": ("sale_9l_case", p.this_year),
    }, case_insensitive=True)


def origin_level(b: DataFrame) -> DataFrame:
    """Re-aggregate brand -> origin (sums are distributive)."""
    return b.groupBy(*MARKET, "origin").agg(F.sum("sale_ly").alias("total_sale_ly"),
                                             F.sum("sale_ty").alias("total_sale_ty"))


def varietal_level(ol: DataFrame) -> DataFrame:
    """Re-aggregate origin -> varietal."""
    return ol.groupBy(*MARKET).agg(F.sum("total_sale_ly").alias("total_sale_ly"),
                                    F.sum("total_sale_ty").alias("total_sale_ty"))


def varietal_performance(ol: DataFrame) -> DataFrame:
    """Varietal volume, YoY (fraction), share of the province, rank in province."""
    v = varietal_level(ol)
    return v.select(
        *MARKET, "total_sale_ty",
        yoy("total_sale_ty", "total_sale_ly", 1.0).alias("varietal_volume_growth_yoy"),
        M.share("total_sale_ty", ["province_code"], 1.0).alias("varietal_market_share_ty"),
        M.row_number(["province_code"], M.order_desc("total_sale_ty", "total_sale_ly", tiebreak=("varietal",)))
         .alias("varietal_rank_by_volume"),
    )


def origin_ranked(ol: DataFrame) -> DataFrame:
    return ol.select(
        "*",
        yoy("total_sale_ty", "total_sale_ly", 1.0).alias("origin_volume_growth_yoy"),
        M.share("total_sale_ty", MARKET, 1.0).alias("origin_market_share_ty"),
        M.row_number(MARKET, M.order_desc("total_sale_ty", "total_sale_ly", tiebreak=("origin",)))
         .alias("origin_rank_by_volume"),
    )


def top_origin(ol: DataFrame, p: MarketParams) -> DataFrame:
    """Top origin per varietal (argmax pivot) and the home origin's stats."""
    r = origin_ranked(ol)
    home = ieq("origin", p.origin)
    rk = "origin_rank_by_volume"
    return r.groupBy(*MARKET).agg(
        M.at_rank(rk, "origin").alias("top_origin"),
        M.at_rank(rk, "total_sale_ty").alias("top_origin_volume_sale"),
        M.at_rank(rk, "origin_volume_growth_yoy").alias("top_origin_volume_growth_yoy"),
        M.at_rank(rk, "origin_market_share_ty").alias("top_origin_market_share"),
        M.at_entity(home, "total_sale_ty").alias("home_origin_volume_sale"),
        M.at_entity(home, "origin_volume_growth_yoy", default=0.0).alias("home_origin_volume_growth_yoy"),
        M.at_entity(home, "origin_market_share_ty", default=0.0).alias("home_origin_market_share"),
    )


BRAND_ORDER_COLS = ("sale_ty", "sale_ly")


def market_leader(b: DataFrame) -> DataFrame:
    """Rank-1 brand over all origins; grain (origin, brand), so one brand sold
    under two origins competes with itself."""
    r = b.select(
        "*",
        yoy("sale_ty", "sale_ly", 1.0).alias("brand_volume_growth_yoy"),
        M.share("sale_ty", MARKET, 1.0).alias("brand_market_share_ty"),
        M.row_number(MARKET, M.order_desc(*BRAND_ORDER_COLS, tiebreak=("brand", "origin"))).alias("brand_rank_by_volume"),
    ).filter(F.col("brand_rank_by_volume") == 1)
    return r.select(*MARKET, F.col("origin").alias("market_leader_origin"),
                    F.col("brand").alias("market_leader_brand"),
                    F.col("sale_ty").alias("market_leader_volume"),
                    F.col("brand_volume_growth_yoy").alias("market_leader_volume_growth_yoy"),
                    F.col("brand_market_share_ty").alias("market_leader_market_share_ty"))


def origin_leader(b: DataFrame, p: MarketParams) -> DataFrame:
    """Leader within the home origin and the focal brand there (share of the
    home origin's volume). Home rows are flagged, not filtered, so the base plan is
    shared with the other consumers; non-home rows form their own window partitions
    and are ignored by the conditional aggregates."""
    home = F.col("__home")
    keys = MARKET + ["__home"]
    r = b.withColumn("__home", ieq("origin", p.origin)).select(
        "*",
        yoy("sale_ty", "sale_ly", 1.0).alias("brand_volume_growth_yoy"),
        M.share("sale_ty", keys, 1.0).alias("brand_market_share_ty"),
        M.row_number(keys, M.order_desc(*BRAND_ORDER_COLS, tiebreak=("brand", "origin"))).alias("brand_rank_by_volume"),
    )
    top = home & (F.col("brand_rank_by_volume") == 1)
    focal = home & ieq("brand", p.focal_brand)
    return r.groupBy(*MARKET).agg(
        F.max(F.when(top, F.col("brand"))).alias("home_top_brand"),
        F.max(F.when(top, F.col("sale_ty"))).alias("home_top_brand_volume"),
        F.max(F.when(top, F.col("brand_volume_growth_yoy"))).alias("home_top_brand_volume_growth_yoy"),
        F.max(F.when(top, F.col("brand_market_share_ty"))).alias("home_top_brand_share_in_origin"),
        M.at_entity(focal, "sale_ty").alias("focal_volume"),
        M.at_entity(focal, "brand_volume_growth_yoy", default=0.0).alias("focal_volume_growth_yoy"),
        M.at_entity(focal, "brand_market_share_ty", default=0.0).alias("focal_share_in_origin"),
        F.max(home.cast("int")).alias("__has_home"),
    ).filter(F.col("__has_home") == 1).drop("__has_home")


BENCHMARK_COLUMNS = [
    "province_name", "varietal", "varietal_total_volume", "varietal_yoy_volume_growth",
    "varietal_market_share_in_province", "varietal_rank_by_volume_in_province",
    "top_origin", "top_origin_total_volume", "top_origin_yoy_volume_growth", "top_origin_market_share",
    "home_origin_total_volume", "home_origin_yoy_volume_growth", "home_origin_market_share",
    "market_leader_brand_origin", "market_leader_brand", "market_leader_brand_total_volume",
    "market_leader_brand_yoy_volume_growth", "market_leader_brand_market_share",
    "home_origin_top_brand", "home_origin_top_brand_total_volume",
    "home_origin_top_brand_yoy_volume_growth", "home_origin_top_brand_market_share",
    "focal_total_volume", "focal_yoy_volume_growth", "focal_market_share", "focal_presence",
]


def varietal_benchmark(sales: DataFrame, periods: DataFrame, provinces: DataFrame, p: MarketParams,
                       unit_size: int = 750) -> DataFrame:
    """Four-way left join of the per-varietal pieces onto varietal performance.
    Shares of the home-origin leader and the focal brand are chained (share within
    the home origin x the home origin's share) into shares of the varietal (J39);
    presence is 1 when the focal brand sold this year (J40)."""
    b = base(sales, periods, p, unit_size)
    ol = origin_level(b)
    v = varietal_performance(ol)
    o = top_origin(ol, p)
    lead = market_leader(b)
    u = origin_leader(b, p)
    j = (v.join(provinces.select("province_code", "province_name"), "province_code", "left")
          .join(o, MARKET, "left").join(lead, MARKET, "left").join(u, MARKET, "left"))
    return j.select(
        "province_name", "varietal",
        F.col("total_sale_ty").alias("varietal_total_volume"),
        F.col("varietal_volume_growth_yoy").alias("varietal_yoy_volume_growth"),
        F.col("varietal_market_share_ty").alias("varietal_market_share_in_province"),
        F.col("varietal_rank_by_volume").alias("varietal_rank_by_volume_in_province"),
        "top_origin",
        F.col("top_origin_volume_sale").alias("top_origin_total_volume"),
        F.col("top_origin_volume_growth_yoy").alias("top_origin_yoy_volume_growth"),
        "top_origin_market_share",
        F.col("home_origin_volume_sale").alias("home_origin_total_volume"),
        F.col("home_origin_volume_growth_yoy").alias("home_origin_yoy_volume_growth"),
        "home_origin_market_share",
        F.col("market_leader_origin").alias("market_leader_brand_origin"),
        "market_leader_brand",
        F.col("market_leader_volume").alias("market_leader_brand_total_volume"),
        F.col("market_leader_volume_growth_yoy").alias("market_leader_brand_yoy_volume_growth"),
        F.col("market_leader_market_share_ty").alias("market_leader_brand_market_share"),
        F.col("home_top_brand").alias("home_origin_top_brand"),
        F.col("home_top_brand_volume").alias("home_origin_top_brand_total_volume"),
        F.col("home_top_brand_volume_growth_yoy").alias("home_origin_top_brand_yoy_volume_growth"),
        (F.col("home_top_brand_share_in_origin") * F.col("home_origin_market_share")).alias("home_origin_top_brand_market_share"),
        F.col("focal_volume").alias("focal_total_volume"),
        F.col("focal_volume_growth_yoy").alias("focal_yoy_volume_growth"),
        (F.col("focal_share_in_origin") * F.col("home_origin_market_share")).alias("focal_market_share"),
        F.when(F.col("focal_volume") > 0, 1).otherwise(0).alias("focal_presence"),
    )

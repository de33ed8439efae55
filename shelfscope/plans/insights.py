"""Insight metrics behind the findings and dashboards (national trend, ranks, per
capita, regional mix, challengers, consistent ranks, format structure, portfolio
gaps, price histogram, price x volume).

Each metric starts from one aggregate over the fact table; national totals are
scalar subqueries (one row) rather than un-partitioned windows, so no step pulls
a whole table into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.functions.numeric import ratio, ratio0, yoy
from shelfscope.functions.text import ieq
from shelfscope.operators import measures as M
from shelfscope.operators.conform import with_relative_year
from shelfscope.params import MarketParams

LYTY = lambda p: {"sale_ly": ("sale_9l_case", p.last_year), "sale_ty": ("sale_9l_case", p.this_year)}


def _base(sales: DataFrame, periods: DataFrame, keys: list[str], p: MarketParams) -> DataFrame:
    return M.rolling_year(with_relative_year(sales, periods), keys, LYTY(p))


def national_trend(sales: DataFrame, periods: DataFrame, p: MarketParams) -> DataFrame:
    """L1: whole-market and focal-brand LY/TY volume, absolute change and YoY %."""
    s = with_relative_year(sales, periods)
    ly, ty = F.col("relative_year") == p.last_year, F.col("relative_year") == p.this_year
    focal = ieq("brand", p.focal_brand)
    v = F.col("sale_9l_case")
    t = s.agg(F.sum(F.when(ly, v)).alias("market_ly"), F.sum(F.when(ty, v)).alias("market_ty"),
              F.sum(F.when(ly & focal, v)).alias("focal_ly"), F.sum(F.when(ty & focal, v)).alias("focal_ty"))
    return t.select("market_ly", "market_ty", (F.col("market_ty") - F.col("market_ly")).alias("market_change"),
                    yoy("market_ty", "market_ly").alias("market_yoy_pct"),
                    "focal_ly", "focal_ty", yoy("focal_ty", "focal_ly").alias("focal_yoy_pct"))


def national_rank(sales: DataFrame, periods: DataFrame, p: MarketParams) -> DataFrame:
    """L2: brands ranked nationally by TY volume within the home origin."""
    b = _base(sales.filter(ieq("origin", p.origin)), periods, ["brand"], p)
    b = b.select("brand", "sale_ly", "sale_ty", yoy("sale_ty", "sale_ly").alias("yoy_pct"))
    # national ranking without an un-partitioned window (see measures.global_row_number)
    return M.global_row_number(b, "sale_ty", ("brand",), out="national_rank")


def per_capita(sales: DataFrame, periods: DataFrame, population: DataFrame, p: MarketParams,
               reference_province: str) -> DataFrame:
    """L3: TY volume per head by province and its ratio to a reference province."""
    b = _base(sales, periods, ["province_code"], p).join(population, "province_code")
    b = b.withColumn("per_capita", ratio("sale_ty", "population"))
    # a window over one row a province
    ref = F.max(F.when(F.col("province_code") == reference_province, F.col("per_capita"))).over(Window.partitionBy(F.lit(1)))
    return b.select("province_code", "sale_ty", "population", "per_capita",
                    (F.col("per_capita") / F.nullif(ref, F.lit(0.0))).alias("ratio_to_reference"))


def region_mix(sales: DataFrame, periods: DataFrame, p: MarketParams) -> DataFrame:
    """L4: each province's share of the focal brand's national TY volume."""
    f = _base(sales.filter(ieq("brand", p.focal_brand)), periods, ["province_code"], p)
    national = f.select(F.sum("sale_ty")).scalar()
    return f.select("province_code", "sale_ty", ratio0("sale_ty", national, 100.0).alias("share_of_focal_pct"))


def _home_markets(sales: DataFrame, periods: DataFrame, p: MarketParams) -> DataFrame:
    mk = ["province_code", "varietal"]
    b = _base(sales.filter(ieq("origin", p.origin)), periods, mk + ["brand"], p)
    return b.select("*", yoy("sale_ty", "sale_ly").alias("yoy_pct"),
                    M.share("sale_ty", mk).alias("share_pct"),
                    M.row_number(mk, M.order_desc("sale_ty", "sale_ly", tiebreak=("brand",))).alias("rank"))


def challengers(sales: DataFrame, periods: DataFrame, p: MarketParams) -> DataFrame:
    """Brands below the home-origin leader growing faster than the leader."""
    r = _home_markets(sales, periods, p)
    mk = ["province_code", "varietal"]
    w = Window.partitionBy(*mk)
    lead_yoy = F.max(F.when(F.col("rank") == 1, F.col("yoy_pct"))).over(w)
    lead_brand = F.max(F.when(F.col("rank") == 1, F.col("brand"))).over(w)
    r = r.select("*", lead_brand.alias("leader_brand"), lead_yoy.alias("leader_yoy_pct"))
    return r.filter((F.col("rank") > 1) & (F.col("yoy_pct") > F.col("leader_yoy_pct"))).select(
        *mk, "leader_brand", "leader_yoy_pct", "brand", "rank", "yoy_pct", "share_pct")


def consistent_rank(sales: DataFrame, periods: DataFrame, p: MarketParams) -> DataFrame:
    """Per (varietal, brand) across provinces: rank range and whether the brand
    declined in every province where it sold in both years."""
    r = _home_markets(sales, periods, p)
    return r.groupBy("varietal", "brand").agg(
        F.count(F.lit(1)).alias("provinces"),
        F.min("rank").alias("min_rank"), F.max("rank").alias("max_rank"),
        (F.min("rank") == F.max("rank")).cast("int").alias("same_rank_everywhere"),
        # 1 when the brand fell in every province with sales in both years (and there
        # is at least one such province); 0 otherwise
        F.coalesce(F.bool_and(F.col("sale_ty") < F.col("sale_ly")), F.lit(False)).cast("int")
         .alias("declining_everywhere"),
    )


def format_share(sales: DataFrame, periods: DataFrame, p: MarketParams) -> DataFrame:
    """Each format's share of its (province, varietal) TY volume."""
    b = _base(sales, periods, ["province_code", "varietal", "unit_size"], p)
    return b.select("province_code", "varietal", "unit_size", "sale_ty",
                    M.share("sale_ty", ["province_code", "varietal"]).alias("format_share_pct"))


def format_leader(sales: DataFrame, periods: DataFrame, p: MarketParams) -> DataFrame:
    """Top brand inside each (province, varietal, format) and its share."""
    k = ["province_code", "varietal", "unit_size"]
    b = _base(sales, periods, k + ["brand"], p)
    r = b.select("*", M.share("sale_ty", k).alias("leader_share_pct"),
                 M.row_number(k, M.order_desc("sale_ty", "sale_ly", tiebreak=("brand",))).alias("rn"))
    return r.filter(F.col("rn") == 1).select(*k, F.col("brand").alias("leader_brand"), "sale_ty", "leader_share_pct")


def portfolio_gap(sales: DataFrame, periods: DataFrame, p: MarketParams,
                  keys: tuple[str, ...] = ("province_code", "varietal")) -> DataFrame:
    """Markets (``keys``) without focal-brand sales this year, ranked by market
    volume within the province.

    One aggregate carries both the market volume and the focal brand's volume, so the
    gaps are a filter on its rows.
    """
    mk = list(keys)
    s = with_relative_year(sales, periods)
    ty = F.col("relative_year") == p.this_year
    agg = s.groupBy(*mk).agg(
        F.sum(F.when(ty, F.col("sale_9l_case"))).alias("sale_ty"),
        F.sum(F.when(ty & ieq("brand", p.focal_brand), F.col("sale_9l_case"))).alias("focal_ty"))
    gaps = agg.filter(~F.coalesce(F.col("focal_ty") > 0, F.lit(False)))
    tie = tuple(k for k in mk if k != "province_code")
    return gaps.select(*mk, F.col("sale_ty").alias("market_volume_ty"),
                       M.row_number(["province_code"], M.order_desc("sale_ty", tiebreak=tie)).alias("gap_rank"))


def price_histogram(products: DataFrame) -> DataFrame:
    """Number of products per price segment (unbanded prices form their own bar)."""
    return products.groupBy("price_segment").agg(F.count(F.lit(1)).alias("products"))


def price_volume(pricing: DataFrame) -> DataFrame:
    """Price x volume per flagship SKU (scatter input)."""
    return pricing.select("province_code", "varietal", "unit_size", "brand", "product_code", "retail_price",
                          "price_segment", "sale_ty")

"""Flagship pricing report: the flagship SKU of each brand per (province, varietal,
format) segment, the brand's share, cumulative-share tier and rank, cut at a
cumulative share.

Evaluation order that matters: brand totals and shares are computed over *all*
SKUs before the rank-1 filter; segment totals from the brand totals; the running brand share over flagship rows only;
LAG over all flagship rows before the cut; the final ROW_NUMBER after the cut.

Physical shape: the fact aggregate runs first at SKU grain; the product dim is
joined to that aggregate (one row per SKU and segment) instead of to every fact
row -- equivalent because ``global_code`` is the dim's key. SKU rows are shuffled by
brand; only flagship rows are shuffled by segment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.functions.numeric import ratio, ratio0, yoy
from shelfscope.operators import measures as M
from shelfscope.operators.conform import market_filter, with_price, with_relative_year
from shelfscope.operators.filters import share_cutoff
from shelfscope.params import MarketParams

SEGMENT = ["province_code", "varietal", "unit_size"]
BRAND = SEGMENT + ["brand"]
SKU_KEYS = BRAND + ["product_code", "product_name", "price_segment"]
SKU_ORDER_COLS = ("sale_ty", "revenue_ty", "sale_ly", "revenue_ly")


def flagship_base(sales: DataFrame, periods: DataFrame, products: DataFrame, p: MarketParams) -> DataFrame:
    """LY/TY volume and revenue per SKU (8 keys incl. retail price)."""
    s = with_relative_year(sales, periods)
    s = s.filter(market_filter(p.origin, p.exception_varietal, p.exception_origin))
    agg = M.rolling_year(s, SKU_KEYS, {
        "sale_ly": ("sale_9l_case", p.last_year), "sale_ty": ("sale_9l_case", p.this_year),
        "revenue_ly": ("revenue", p.last_year), "revenue_ty": ("revenue", p.this_year),
    })
    agg = with_price(agg, products).withColumnRenamed("retail_price_this_year", "retail_price")
    return agg.select(*BRAND, "product_code", "product_name", "retail_price", "price_segment",
                      "sale_ly", "sale_ty", "revenue_ly", "revenue_ty")


def flagship_candidates(base: DataFrame) -> DataFrame:
    """Each brand's flagship SKUs (rank 1 within the brand; RANK keeps exact
    ties), SKU share of brand, brand total and brand share of the segment.

    SKU rows are windowed by brand only. What goes on to the few segment partitions is
    the flagship rows, one a brand but for ties; a segment's total is the sum of its
    brands' totals, each counted once.
    """
    order = M.order_desc(*SKU_ORDER_COLS)
    flagship = base.select(
        "*",
        M.rank(BRAND, order).alias("sku_rank_by_volume"),
        M.row_number(BRAND, order + [F.col("product_code").asc_nulls_first()]).alias("__first"),
        M.total_over("sale_ty", BRAND).alias("brand_total_sale_ty"),
    ).filter(F.col("sku_rank_by_volume") == 1)
    seg_total = M.total_over(F.when(F.col("__first") == 1, F.col("brand_total_sale_ty")), SEGMENT)
    return flagship.select(
        *base.columns, "sku_rank_by_volume",
        ratio0("sale_ty", "brand_total_sale_ty", 100.0).alias("sku_volume_share_for_brand_pct"),
        "brand_total_sale_ty",
        ratio("brand_total_sale_ty", seg_total, 100.0).alias("brand_market_share_pct"),
    )


def brand_order():
    return M.order_desc("brand_market_share_pct", "retail_price", *SKU_ORDER_COLS,
                        tiebreak=("brand", "product_code"))


def flagship_cumulative(cand: DataFrame) -> DataFrame:
    """Running brand share and its lag (COALESCE 0)."""
    o = brand_order()
    cum = M.running_sum("brand_market_share_pct", SEGMENT, o)
    return (cand.withColumn("brand_cum_market_share", cum)
              .withColumn("lag_brand_cum_market_share", M.lagged("brand_cum_market_share", SEGMENT, o, default0=True)))


PRICING_COLUMNS = ["province_code", "varietal", "unit_size", "brand", "product_code", "retail_price",
                   "price_segment", "sale_ly", "sale_ty", "sku_yoy_volume_change_frac", "revenue_ly",
                   "revenue_ty", "sku_volume_share_for_brand_pct", "brand_total_sale_ty",
                   "brand_market_share_frac", "brand_tier", "brand_rank_by_volume"]


def flagship_pricing(sales: DataFrame, periods: DataFrame, products: DataFrame, p: MarketParams) -> DataFrame:
    """Cut at the cumulative share, tier (inclusive bounds) and rank after the cut."""
    cum = flagship_cumulative(flagship_candidates(flagship_base(sales, periods, products, p)))
    kept = share_cutoff(cum, "lag_brand_cum_market_share", p.cum_share_cutoff)
    rank_order = M.order_desc("brand_total_sale_ty", *SKU_ORDER_COLS, tiebreak=("brand", "product_code"))
    return kept.select(
        *SEGMENT, "brand", "product_code", "retail_price", "price_segment", "sale_ly", "sale_ty",
        yoy("sale_ty", "sale_ly", 1.0).alias("sku_yoy_volume_change_frac"),
        "revenue_ly", "revenue_ty", "sku_volume_share_for_brand_pct", "brand_total_sale_ty",
        (F.col("brand_market_share_pct") / F.lit(100.0)).alias("brand_market_share_frac"),
        M.tier("lag_brand_cum_market_share", p.tier1_threshold, p.tier2_threshold, inclusive=True).alias("brand_tier"),
        M.row_number(SEGMENT, rank_order).alias("brand_rank_by_volume"),
    )

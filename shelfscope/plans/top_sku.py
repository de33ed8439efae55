"""Top-N SKUs per province for one varietal and format.

Period and product dims are LEFT joined: a SKU whose sales fall outside both rolling
years keeps its group with NULL sums (E2/E4). The rank filter is planned as a
``WindowGroupLimit`` so each task forwards only its local top N per province.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.functions.numeric import ratio, yoy
from shelfscope.operators import measures as M
from shelfscope.operators.conform import with_price, with_relative_year
from shelfscope.operators.filters import top_n, where_format, where_varietal
from shelfscope.params import MarketParams

KEYS = ["province_code", "origin", "brand", "product_code", "price_segment"]


def top_sku_base(sales: DataFrame, periods: DataFrame, products: DataFrame, p: MarketParams) -> DataFrame:
    s = where_varietal(where_format(sales, p.unit_size), p.varietal)
    s = with_relative_year(s, periods, how="left")
    agg = M.rolling_year(s, KEYS, {"sale_ly": ("sale_9l_case", p.last_year),
                                   "sale_ty": ("sale_9l_case", p.this_year)}, case_insensitive=True)
    return with_price(agg, products, how="left")


def top_sku(sales: DataFrame, periods: DataFrame, products: DataFrame, p: MarketParams) -> DataFrame:
    """The rank filter alone is a map-side top N; a province's total comes from an aggregate
    of the same SKU rows (one row a province) that is joined to the few that are left.
    The total is NULL or 0 exactly where the share is NULL; reading both years' sums lets
    Spark reuse the SKU aggregate's exchange for it."""
    b = top_sku_base(sales, periods, products, p)
    order = M.order_desc("sale_ty", "sale_ly", tiebreak=("brand", "product_code", "origin"))
    total = F.coalesce(F.sum("sale_ty"), F.sum("sale_ly") * F.lit(0))
    totals = b.groupBy(F.col("province_code").alias("__province")).agg(total.alias("__total"))
    top = top_n(b, ["province_code"], order, p.top_n, "rank_by_volume")
    return top.join(totals, F.col("province_code") == F.col("__province")).select(
        *KEYS, "retail_price_this_year", "sale_ly", "sale_ty",
        yoy("sale_ty", "sale_ly", 1.0).alias("volume_growth_frac"),
        ratio("sale_ty", "__total", 100.0).alias("market_share_pct"), "rank_by_volume")

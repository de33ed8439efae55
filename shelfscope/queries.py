"""Registered queries: each runs one operator or report over the proxy market built
from the test tables at ``sf_dir``. Importing this module fills
``shelfscope.catalog.REGISTRY``."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from shelfscope.catalog import register
from shelfscope.params import DEFAULT
from shelfscope.plans import outlook
from shelfscope.sources import proxy

P = DEFAULT
FORMAT_ML = 3000

# ---------------------------------------------------------------- market outlook

OUTLOOK_DOUBLES = ("hhi_ly", "hhi_ty", "cr3", "cr5", "cr10", "total_market_sale_ty", "market_yoy_change",
                   "focal_total_sale_ty", "focal_yoy_sale_change", "focal_market_share_ly",
                   "focal_market_share_ty", "focal_market_share_growth",
                   "tier_1_yoy_change", "tier_2_yoy_change", "tier_3_yoy_change",
                   "tier_1_market_share_change", "tier_2_market_share_change", "tier_3_market_share_change")
OUTLOOK_INTS = ("total_active_brands", "focal_rank_by_volume", "focal_tier_by_volume",
                "tier_1_brands_count", "tier_2_brands_count", "tier_3_brands_count")


def _market(spark: SparkSession, d: str):
    return proxy.calc_sales(spark, d, window=True, portfolio=True), proxy.report_periods(spark), proxy.varietal_dim(spark, d)


@register("market_outlook", OUTLOOK_DOUBLES, OUTLOOK_INTS)
def q_market_outlook(spark, d):
    return outlook.market_outlook(*_market(spark, d), P)


@register("market_outlook_format", OUTLOOK_DOUBLES, OUTLOOK_INTS)
def q_market_outlook_format(spark, d):
    return outlook.market_outlook(*_market(spark, d), P.with_(unit_size=FORMAT_ML))


# ------------------------------------------------------- outlook building blocks

def _mo_base(spark, d, p=P):
    return outlook.brand_base(*_market(spark, d), p)


BASE_D = ("sale_vol_ly", "sale_vol_ty", "revenue_ly", "revenue_ty")


@register("market_base", BASE_D)
def q_market_base(spark, d):
    return _mo_base(spark, d)


@register("market_base_untidy", BASE_D)
def q_market_base_untidy(spark, d):
    """Origins with edge spaces and mixed case give the same base, from the dim's flag."""
    sales = proxy.calc_sales(spark, d, window=True).withColumn(
        "origin", F.when(F.crc32("product_code") % 3 == 0, F.concat(F.lit(" "), F.initcap("origin"), F.lit("  "))).otherwise(F.col("origin")))
    return outlook.brand_base(sales, proxy.report_periods(spark), proxy.varietal_dim(spark, d), P)


@register("market_share_rank", BASE_D + ("market_share_ly", "market_share_ty", "cum_market_share_ty"), ("rank_by_sale",))
def q_market_share_rank(spark, d):
    return outlook.ranked(_mo_base(spark, d))


@register("win_share", ("market_share_ly", "market_share_ty"))
def q_win_share(spark, d):
    return outlook.ranked(_mo_base(spark, d)).select("province_code", "varietal", "brand",
                                                     "market_share_ly", "market_share_ty")


@register("win_running_share", ("sale_vol_ty", "cum_market_share_ty"))
def q_win_running_share(spark, d):
    return outlook.ranked(_mo_base(spark, d)).select("province_code", "varietal", "brand",
                                                     "sale_vol_ty", "cum_market_share_ty")


@register("win_lag_cum", ("cum_market_share_ty", "lag_cum_market_share"))
def q_win_lag_cum(spark, d):
    from shelfscope.operators import measures as M
    rk = outlook.ranked(_mo_base(spark, d))
    return rk.select("province_code", "varietal", "brand", "cum_market_share_ty",
                     M.lagged("cum_market_share_ty", outlook.MARKET, outlook.brand_order()).alias("lag_cum_market_share"))


SEG_D = BASE_D + ("market_share_ly", "market_share_ty", "market_share_growth")


@register("market_tiers", SEG_D, ("rank_by_sale", "tier"))
def q_market_tiers(spark, d):
    return outlook.segmented(outlook.ranked(_mo_base(spark, d)), P)


def _kpis(spark, d):
    return outlook.market_kpis(outlook.segmented(outlook.ranked(_mo_base(spark, d)), P), P)


@register("market_concentration", ("hhi_ly", "hhi_ty", "cr3", "cr5", "cr10"))
def q_market_concentration(spark, d):
    return _kpis(spark, d).select("province_code", "varietal", "hhi_ly", "hhi_ty", "cr3", "cr5", "cr10")


@register("hhi_segment", ("hhi_ty",))
def q_hhi_segment(spark, d):
    return outlook.positioned(_kpis(spark, d)).select("province_code", "varietal", "hhi_ty", "hhi_segment")


@register("market_performance", ("total_market_sale_ty", "market_yoy_change"), ("total_active_brands",))
def q_market_performance(spark, d):
    return _kpis(spark, d).select("province_code", "varietal", "total_market_sale_ty", "total_active_brands",
                                  "market_yoy_change")


FOCAL_COLS = ("focal_total_sale_ty", "focal_yoy_sale_change", "focal_market_share_ly", "focal_market_share_ty",
              "focal_market_share_growth")


@register("focal_kpis", FOCAL_COLS, ("focal_rank_by_volume", "focal_tier_by_volume"))
def q_focal_kpis(spark, d):
    return _kpis(spark, d).select("province_code", "varietal", "focal_rank_by_volume", "focal_tier_by_volume",
                                  *FOCAL_COLS)


TIER_D = tuple(f"tier_{t}_{m}" for m in ("yoy_change", "market_share_change") for t in (1, 2, 3))
TIER_I = tuple(f"tier_{t}_brands_count" for t in (1, 2, 3))


@register("tier_kpis", TIER_D, TIER_I)
def q_tier_kpis(spark, d):
    return _kpis(spark, d).select("province_code", "varietal", *TIER_D, *TIER_I)


@register("archetype")
def q_archetype(spark, d):
    return outlook.positioned(_kpis(spark, d)).select(
        "province_code", "varietal", "focal_archetype_position", "focal_archetype_1st_part", "focal_archetype_2nd_part")


@register("filter_portfolio", ("sale_9l_case", "revenue"))
def q_filter_portfolio(spark, d):
    from shelfscope.operators.conform import with_relative_year
    from shelfscope.operators.filters import where_market
    sales = proxy.calc_sales(spark, d, window=True, portfolio=True)
    s = where_market(with_relative_year(sales, proxy.report_periods(spark)), P.origin, P.exception_varietal,
                     P.exception_origin, portfolio_col="in_portfolio")
    return s.select("province_code", "varietal", "brand", "origin", "period_code", "relative_year",
                    "sale_9l_case", "revenue")


@register("agg_rolling_year", ("sale_ly", "sale_ty", "revenue_ly", "revenue_ty"))
def q_agg_rolling_year(spark, d):
    from shelfscope.operators import measures as M
    from shelfscope.operators.conform import with_relative_year
    sales, periods, _ = _market(spark, d)
    return M.rolling_year(with_relative_year(sales, periods), ["province_code", "varietal", "origin"], {
        "sale_ly": ("sale_9l_case", "LRY"), "sale_ty": ("sale_9l_case", "TRY"),
        "revenue_ly": ("revenue", "LRY"), "revenue_ty": ("revenue", "TRY")})


# ------------------------------------------------------------- flagship pricing

from shelfscope.plans import flagship  # noqa: E402

FL_D = ("retail_price", "sale_ly", "sale_ty", "revenue_ly", "revenue_ty")


def _fl_base(spark, d):
    return flagship.flagship_base(proxy.calc_sales(spark, d, window=True), proxy.report_periods(spark),
                                  proxy.products(spark, d), P)


@register("flagship_base", FL_D, ("unit_size",))
def q_flagship_base(spark, d):
    return _fl_base(spark, d)


@register("flagship_sku", FL_D + ("sku_volume_share_for_brand_pct", "brand_total_sale_ty", "brand_market_share_pct"),
          ("unit_size", "sku_rank_by_volume"))
def q_flagship_sku(spark, d):
    return flagship.flagship_candidates(_fl_base(spark, d))


@register("brand_cutoff", ("brand_market_share_pct", "brand_cum_market_share", "lag_brand_cum_market_share"),
          ("unit_size",))
def q_brand_cutoff(spark, d):
    from shelfscope.operators.filters import share_cutoff
    cum = flagship.flagship_cumulative(flagship.flagship_candidates(_fl_base(spark, d)))
    return share_cutoff(cum, "lag_brand_cum_market_share", P.cum_share_cutoff).select(
        "province_code", "varietal", "unit_size", "brand", "product_code", "brand_market_share_pct",
        "brand_cum_market_share", "lag_brand_cum_market_share")


@register("flagship_pricing", FL_D + ("sku_yoy_volume_change_frac", "sku_volume_share_for_brand_pct",
                                      "brand_total_sale_ty", "brand_market_share_frac"),
          ("unit_size", "brand_tier", "brand_rank_by_volume"))
def q_flagship_pricing(spark, d):
    return flagship.flagship_pricing(proxy.calc_sales(spark, d, window=True), proxy.report_periods(spark),
                                     proxy.products(spark, d), P)


@register("filter_origin_exception", ("sale_9l_case",), ("unit_size",))
def q_filter_origin_exception(spark, d):
    from shelfscope.operators.filters import where_market
    s = where_market(proxy.calc_sales(spark, d), P.origin, P.exception_varietal, P.exception_origin)
    return s.select("province_code", "varietal", "unit_size", "brand", "product_code", "origin", "period_code",
                    "sale_9l_case")


# ------------------------------------------------------------ varietal benchmark

from shelfscope.plans import benchmark as VB  # noqa: E402


def _vb_base(spark, d):
    return VB.base(proxy.calc_sales(spark, d, window=True), proxy.report_periods(spark), P)


@register("agg_origin_level", ("total_sale_ly", "total_sale_ty"))
def q_agg_origin_level(spark, d):
    return VB.origin_level(_vb_base(spark, d))


@register("agg_varietal_level", ("total_sale_ly", "total_sale_ty"))
def q_agg_varietal_level(spark, d):
    return VB.varietal_level(VB.origin_level(_vb_base(spark, d)))


@register("varietal_performance", ("total_sale_ty", "varietal_volume_growth_yoy", "varietal_market_share_ty"),
          ("varietal_rank_by_volume",))
def q_varietal_performance(spark, d):
    return VB.varietal_performance(VB.origin_level(_vb_base(spark, d)))


TOP_ORIGIN_D = ("top_origin_volume_sale", "top_origin_volume_growth_yoy", "top_origin_market_share",
                "home_origin_volume_sale", "home_origin_volume_growth_yoy", "home_origin_market_share")


@register("top_origin", TOP_ORIGIN_D)
def q_top_origin(spark, d):
    return VB.top_origin(VB.origin_level(_vb_base(spark, d)), P)


@register("agg_argmax_pivot", TOP_ORIGIN_D[:3])
def q_agg_argmax_pivot(spark, d):
    return VB.top_origin(VB.origin_level(_vb_base(spark, d)), P).select(
        "province_code", "varietal", "top_origin", *TOP_ORIGIN_D[:3])


@register("origin_stats", TOP_ORIGIN_D[3:])
def q_origin_stats(spark, d):
    return VB.top_origin(VB.origin_level(_vb_base(spark, d)), P).select(
        "province_code", "varietal", *TOP_ORIGIN_D[3:])


@register("market_leader", ("market_leader_volume", "market_leader_volume_growth_yoy", "market_leader_market_share_ty"))
def q_market_leader(spark, d):
    return VB.market_leader(_vb_base(spark, d))


@register("origin_leader", ("home_top_brand_volume", "home_top_brand_volume_growth_yoy",
                            "home_top_brand_share_in_origin", "focal_volume", "focal_volume_growth_yoy",
                            "focal_share_in_origin"))
def q_origin_leader(spark, d):
    return VB.origin_leader(_vb_base(spark, d), P)


BENCH_D = ("varietal_total_volume", "varietal_yoy_volume_growth", "varietal_market_share_in_province",
           "top_origin_total_volume", "top_origin_yoy_volume_growth", "top_origin_market_share",
           "home_origin_total_volume", "home_origin_yoy_volume_growth", "home_origin_market_share",
           "market_leader_brand_total_volume", "market_leader_brand_yoy_volume_growth",
           "market_leader_brand_market_share", "home_origin_top_brand_total_volume",
           "home_origin_top_brand_yoy_volume_growth", "home_origin_top_brand_market_share",
           "focal_total_volume", "focal_yoy_volume_growth", "focal_market_share")


@register("varietal_benchmark", BENCH_D, ("varietal_rank_by_volume_in_province", "focal_presence"))
def q_varietal_benchmark(spark, d):
    return VB.varietal_benchmark(proxy.calc_sales(spark, d, window=True), proxy.report_periods(spark),
                                 proxy.province_dim(spark, d), P)


@register("filter_format", ("sale_9l_case",), ("unit_size",))
def q_filter_format(spark, d):
    from shelfscope.operators.filters import where_format
    s = where_format(proxy.calc_sales(spark, d), 750)
    return s.groupBy("province_code", "varietal", "unit_size").agg(F.sum("sale_9l_case").alias("sale_9l_case"))


# ---------------------------------------------------------------- top-N SKUs

from shelfscope.plans import top_sku as TS  # noqa: E402

TOP_P = P.with_(unit_size=750, varietal="LARGE", top_n=3)


@register("top3_sku", ("retail_price_this_year", "sale_ly", "sale_ty", "volume_growth_frac", "market_share_pct"),
          ("rank_by_volume",))
def q_top3_sku(spark, d):
    return TS.top_sku(proxy.calc_sales(spark, d), proxy.report_periods(spark), proxy.products(spark, d), TOP_P)


@register("join_period_left", ("retail_price_this_year", "sale_ly", "sale_ty"))
def q_join_period_left(spark, d):
    return TS.top_sku_base(proxy.calc_sales(spark, d), proxy.report_periods(spark), proxy.products(spark, d), TOP_P)


@register("win_topn", ("sale_ty",), ("rn",))
def q_win_topn(spark, d):
    from shelfscope.operators import measures as M
    from shelfscope.operators.filters import top_n
    b = outlook.brand_base(*_market(spark, d), P)
    return top_n(b.select("province_code", "varietal", "brand", "sale_vol_ty"),
                 ["province_code", "varietal"], M.order_desc("sale_vol_ty", tiebreak=("brand",)), 3) \
        .withColumnRenamed("sale_vol_ty", "sale_ty")


# -------------------------------------------------------------- conformed layer

@register("conf_sales_view", ("sale_9l_case", "revenue"), ("unit_size",))
def q_conf_sales_view(spark, d):
    return proxy.calc_sales(spark, d)


@register("dim_period_analogy", (), ("season",))
def q_dim_period_analogy(spark, d):
    from shelfscope.functions.calendar import fiscal_period, month_label
    from shelfscope.operators.conform import period_analogy
    from shelfscope.sources.tables import read_table
    li = read_table(spark, d, "lineitem", ["l_shipdate"])
    li = li.select(F.to_date("l_shipdate").alias("l_shipdate")).distinct()  # days first: two labels a day, not a row
    labels = li.select(F.explode(F.array(month_label("l_shipdate"), fiscal_period("l_shipdate"))).alias("period_code"))
    return period_analogy(labels, {"M": proxy.MONTHLY_ANCHOR, "P": proxy.FISCAL_ANCHOR})


@register("conf_fiscal_period", ("quantity",), ("lines",))
def q_conf_fiscal_period(spark, d):
    from shelfscope.functions.calendar import fiscal_period
    from shelfscope.sources.tables import read_table
    li = read_table(spark, d, "lineitem", ["l_shipdate", "l_quantity"])
    return li.groupBy(fiscal_period("l_shipdate").alias("fiscal_period")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity"))


@register("filter_origin", ("sale_9l_case",), ("lines",))
def q_filter_origin(spark, d):
    from shelfscope.operators.filters import where_origin
    s = where_origin(proxy.calc_sales(spark, d), "america")
    return s.groupBy("province_code", "varietal", "origin").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("sale_9l_case").alias("sale_9l_case"))


# ----------------------------------------------------------------------- ETL

from shelfscope.plans import etl as ETL  # noqa: E402

ZERO_WHOLESALE = ("AFRICA", "AMERICA", "EUROPE", "MIDDLE EAST")   # every region but ASIA


def _spec(kind: str) -> ETL.CalendarSpec:
    return ETL.CalendarSpec(tuple(proxy.wide_labels(kind)),
                            fix_usa=tuple(proxy.FISCAL_PROVINCES) if kind == "P" else (),
                            zero_wholesale=ZERO_WHOLESALE)


def _raw(spark, d, kind):
    return proxy.raw_wide(spark, d, kind)


def _cleaned(spark, d, kind):
    return ETL.cleaned_attributes(ETL.keyed(_raw(spark, d, kind)), _spec(kind))


def _enriched(spark, d, kind, unmatched="null"):
    return ETL.enriched(_cleaned(spark, d, kind), proxy.color_map(spark), proxy.price_band_rows(), _spec(kind), unmatched)


def _product_branch(spark, d, kind):
    """The ETL's products from the raw file's totals: no period columns are built."""
    cleaned = ETL.cleaned_attributes(ETL.keyed(proxy.raw_totals(spark, d, kind)), _spec(kind))
    return ETL.products_of(ETL.enriched(cleaned, proxy.color_map(spark), proxy.price_band_rows(), _spec(kind)))


def _both(fn):
    from shelfscope.operators.reshape import union_all
    return lambda spark, d: union_all(fn(spark, d, "M"), fn(spark, d, "P"))


@register("etl_tag_key")
def q_etl_tag_key(spark, d):
    return _both(lambda s, dd, k: ETL.keyed(_raw(s, dd, k)).select("province_code", "code", "global_code"))(spark, d)


@register("etl_positive_total", ("total_sale",))
def q_etl_positive_total(spark, d):
    from shelfscope.operators.clean import filter_positive
    return _both(lambda s, dd, k: filter_positive(ETL.keyed(_raw(s, dd, k)), list(_spec(k).period_labels))
                 .select("global_code", "total_sale"))(spark, d)


@register("etl_titlecase")
def q_etl_titlecase(spark, d):
    from shelfscope.operators.clean import TITLECASE_COLUMNS
    return _both(lambda s, dd, k: _cleaned(s, dd, k).select("global_code", *TITLECASE_COLUMNS))(spark, d)


@register("etl_value_replace")
def q_etl_value_replace(spark, d):
    return _both(lambda s, dd, k: _cleaned(s, dd, k).select("global_code", "province_code", "country_of_origin"))(spark, d)


@register("etl_lead_strip")
def q_etl_lead_strip(spark, d):
    return _both(lambda s, dd, k: _cleaned(s, dd, k).select("global_code", "description"))(spark, d)


@register("etl_notnull", (), ("rows",))
def q_etl_notnull(spark, d):
    return _both(lambda s, dd, k: _cleaned(s, dd, k))(spark, d).groupBy("province_code").agg(
        F.count(F.lit(1)).alias("rows"))


@register("etl_color_lookup")
def q_etl_color_lookup(spark, d):
    return _both(lambda s, dd, k: _enriched(s, dd, k).select("global_code", "color", "color_five"))(spark, d)


@register("etl_price_band")
def q_etl_price_band(spark, d):
    return _both(lambda s, dd, k: _enriched(s, dd, k).select("global_code", "retail_price_this_year",
                                                             "price_segment_retail"))(spark, d)


@register("etl_price_band_last")
def q_etl_price_band_last(spark, d):
    return _both(lambda s, dd, k: _enriched(s, dd, k, "last").select("global_code", "retail_price_this_year",
                                                                     "price_segment_retail"))(spark, d)


def _products(spark, d):
    return ETL.conform_products(_product_branch(spark, d, "M"), _product_branch(spark, d, "P"))


def _sales(spark, d):
    return ETL.conform_sales(*(ETL.sales_of(_enriched(spark, d, k), _spec(k)) for k in "MP"))


PRICE_D = ("wholesale_price_last_year", "wholesale_price_this_year", "retail_price_last_year",
           "retail_price_this_year", "retail_price_current")


@register("etl_union_products", PRICE_D, ("size_ml_per_unit", "units_per_case"))
def q_etl_union_products(spark, d):
    return _products(spark, d)


@register("etl_numeric_coerce", PRICE_D)
def q_etl_numeric_coerce(spark, d):
    return _products(spark, d).select("global_code", *PRICE_D)


@register("etl_melt", ("sale_actual_cases",))
def q_etl_melt(spark, d):
    return _both(lambda s, dd, k: ETL.sales_of(ETL.keyed(_raw(s, dd, k)), _spec(k)))(spark, d)


@register("etl_round2", ("rounded",))
def q_etl_round2(spark, d):
    from shelfscope.functions.numeric import round2
    return _both(lambda s, dd, k: ETL.keyed(_raw(s, dd, k)).select(
        "global_code", round2(F.col("wholesale_price_this_year") / F.lit(8.0)).alias("rounded")))(spark, d)


@register("etl_comma_ws")
def q_etl_comma_ws(spark, d):
    from shelfscope.functions.text import squeeze_ws, strip_commas
    return _both(lambda s, dd, k: ETL.keyed(_raw(s, dd, k)).select(
        "global_code", squeeze_ws(strip_commas("description")).alias("description"),
        squeeze_ws(strip_commas("category_prov")).alias("category_prov")))(spark, d)


@register("etl_union_sales", ("sale_actual_cases",))
def q_etl_union_sales(spark, d):
    return _sales(spark, d)


def _etl_view(spark, d):
    return ETL.sales_view(_sales(spark, d), _products(spark, d), proxy.report_periods(spark))


@register("conf_sales_view_etl", ("sale_9l_case", "revenue"), ("unit_size",))
def q_conf_sales_view_etl(spark, d):
    return _etl_view(spark, d)


@register("dim_period_overlap", (), ("days_before", "days", "period_days"))
def q_dim_period_overlap(spark, d):
    """Days that the labels of the delivered files share with the fiscal periods, and with months."""
    from shelfscope.operators.overlap import period_overlap
    labels = _sales(spark, d).select(F.col("sale_period").alias("period_code"))
    return period_overlap(labels, "P").unionByName(period_overlap(labels, "M"))


@register("conf_season_sales", ("sale_9l_case", "revenue"))
def q_conf_season_sales(spark, d):
    """Every product's sales by fiscal period, whichever calendar its province reports on."""
    from shelfscope.operators.overlap import apportioned
    return apportioned(_etl_view(spark, d), "P", ("sale_9l_case", "revenue"), ("province_code", "product_code"))


@register("ins_season_comparison", ("rate_ly", "rate_ty", "rate_change_pct", "season_index", "index_gap"), ("season",))
def q_ins_season_comparison(spark, d):
    from shelfscope.plans import seasons
    return seasons.season_comparison(_etl_view(spark, d), proxy.FISCAL_ANCHOR)


ETL_P = P.with_(origin="NATION_6", exception_varietal="Promo", exception_origin="NATION_7")


@register("market_outlook_etl", OUTLOOK_DOUBLES, OUTLOOK_INTS)
def q_market_outlook_etl(spark, d):
    varietals = proxy.varietal_dim(spark, d).withColumn("varietal", F.initcap("varietal"))
    return outlook.market_outlook(_etl_view(spark, d), proxy.report_periods(spark), varietals, ETL_P)


SPELLED = ("brand", "varietal", "country_of_origin")


def _respelled(products):
    """A third of the products written with accents and an edge space."""
    other = F.crc32("global_code") % 3 == 0
    return products.withColumns({c: F.when(other, F.concat(F.translate(c, "AEIOUaeiou", "ÁÉÍÓÚáéíóú"), F.lit(" "))).otherwise(F.col(c))
                                 for c in SPELLED})


@register("market_outlook_collated", OUTLOOK_DOUBLES, OUTLOOK_INTS)
def q_market_outlook_collated(spark, d):
    """Spellings that differ by case, accents or edge spaces are one brand, varietal and origin."""
    from shelfscope.operators.conform import one_spelling
    varietals = proxy.varietal_dim(spark, d).withColumn("varietal", F.initcap("varietal"))
    products = one_spelling(_respelled(_products(spark, d)), list(SPELLED), {"varietal": varietals})
    view = ETL.sales_view(_sales(spark, d), products, proxy.report_periods(spark))
    return outlook.market_outlook(view, proxy.report_periods(spark), varietals, ETL_P)


@register("dq_null_profile", (), ("null_count",))
def q_dq_null_profile(spark, d):
    from shelfscope.operators.reshape import null_profile
    profiles = _both(lambda s, dd, k: null_profile(_raw(s, dd, k)))(spark, d)
    return profiles.groupBy("column_name").agg(F.sum("null_count").alias("null_count"))


@register("dq_step_counts", (), ("rows",))
def q_dq_step_counts(spark, d):
    from shelfscope.operators.clean import filter_positive, require
    from shelfscope.operators.reshape import counted

    def steps(s, dd, k):
        # the steps themselves; counting drops the text cleaning between them, which keeps every row
        raw = ETL.keyed(proxy.raw_totals(s, dd, k))
        wide = ETL.cleaned_attributes(ETL.keyed(_raw(s, dd, k)), _spec(k))
        positive = filter_positive(raw, [])
        return counted({"raw": raw, "positive_total": positive, "required_attributes": require(positive),
                        "sales_long": ETL.sales_of(wide, _spec(k))})

    return _both(steps)(spark, d).groupBy("step").agg(F.sum("rows").alias("rows"))


@register("fc_promo_codes", (), ("occurrences",))
def q_fc_promo_codes(spark, d):
    return _promo_codes(spark, d)


def _promo_codes(spark, d):
    return _both(lambda s, dd, k: ETL.promo_codes(ETL.keyed(proxy.raw_totals(s, dd, k))))(spark, d)


@register("fc_promo_lift_by_type", ("avg_promoted", "avg_unpromoted", "lift_pct"), ("products",))
def q_fc_promo_lift_by_type(spark, d):
    return FC.promo_lift_by_type(_sales(spark, d), _promo_codes(spark, d))


# ------------------------------------------------------------------ insights

from shelfscope.plans import insights as INS  # noqa: E402


def _sp(spark, d):
    return proxy.calc_sales(spark, d, window=True), proxy.report_periods(spark)


@register("ins_national_trend", ("market_ly", "market_ty", "market_change", "market_yoy_pct", "focal_ly",
                                 "focal_ty", "focal_yoy_pct"))
def q_ins_national_trend(spark, d):
    return INS.national_trend(*_sp(spark, d), P)


@register("ins_national_rank", ("sale_ly", "sale_ty", "yoy_pct"), ("national_rank",))
def q_ins_national_rank(spark, d):
    return INS.national_rank(*_sp(spark, d), P)


@register("ins_per_capita", ("sale_ty", "per_capita", "ratio_to_reference"), ("population",))
def q_ins_per_capita(spark, d):
    return INS.per_capita(*_sp(spark, d), proxy.population(spark, d), P, reference_province="AMERICA")


@register("ins_region_mix", ("sale_ty", "share_of_focal_pct"))
def q_ins_region_mix(spark, d):
    return INS.region_mix(*_sp(spark, d), P)


@register("ins_challengers", ("leader_yoy_pct", "yoy_pct", "share_pct"), ("rank",))
def q_ins_challengers(spark, d):
    return INS.challengers(*_sp(spark, d), P)


@register("ins_consistent_rank", (), ("provinces", "min_rank", "max_rank", "same_rank_everywhere",
                                      "declining_everywhere"))
def q_ins_consistent_rank(spark, d):
    return INS.consistent_rank(*_sp(spark, d), P)


@register("ins_format_share", ("sale_ty", "format_share_pct"), ("unit_size",))
def q_ins_format_share(spark, d):
    return INS.format_share(*_sp(spark, d), P)


@register("ins_format_leader", ("sale_ty", "leader_share_pct"), ("unit_size",))
def q_ins_format_leader(spark, d):
    return INS.format_leader(*_sp(spark, d), P)


@register("ins_portfolio_gap", ("market_volume_ty",), ("unit_size", "gap_rank"))
def q_ins_portfolio_gap(spark, d):
    sales, periods = _sp(spark, d)
    from shelfscope.functions.text import ieq
    return INS.portfolio_gap(sales.filter(ieq("origin", P.origin)), periods, P,
                             keys=("province_code", "varietal", "unit_size"))


@register("ins_price_histogram", (), ("products",))
def q_ins_price_histogram(spark, d):
    return INS.price_histogram(proxy.products(spark, d))


@register("ins_price_volume", ("retail_price", "sale_ty"), ("unit_size",))
def q_ins_price_volume(spark, d):
    return INS.price_volume(q_flagship_pricing(spark, d))


# ------------------------------------------------------------------ forecast

from shelfscope.plans import forecast as FC  # noqa: E402


def _points(spark, d, calendar="month"):
    from shelfscope.sources.tables import read_table
    li = read_table(spark, d, "lineitem", ["l_partkey", "l_quantity", "l_discount", "l_shipdate"])
    part = read_table(spark, d, "part", ["p_partkey", "p_type"])
    s = li.join(part, li.l_partkey == part.p_partkey)
    return FC.series_points(s, "p_type", "l_shipdate", "l_quantity", "l_discount", 5, calendar)


def _points_and_short(spark, d, calendar="month"):
    """The series, and each one's first half of the seasons as a short series of its own."""
    pts = _points(spark, d, calendar)
    copies = F.array(F.col("series"), F.when(F.col("season") <= 6, F.concat(F.col("series"), F.lit(" (H1)"))))
    return pts.withColumn("series", F.explode(F.array_compact(copies)))


def _fit(spark, d):
    pts = _points(spark, d)
    return pts, FC.ols_fit(pts)


@register("fc_promo_lift", ("avg_promoted", "avg_unpromoted", "lift_pct"), ("promoted_periods",))
def q_fc_promo_lift(spark, d):
    return FC.promo_lift(_points(spark, d))


@register("fc_ols_fit", ("promo_slope", "resid_se"), ("n", "seasons"))
def q_fc_ols_fit(spark, d):
    return _fit(spark, d)[1]


@register("fc_organic", ("forecast_median",), ("step", "season"))
def q_fc_organic(spark, d):
    return FC.organic_forecast(_points_and_short(spark, d)).select("series", "step", "target_period", "season",
                                                                   "forecast_median")


@register("fc_organic_fiscal", ("forecast_median", "forecast_high", "forecast_low"), ("step", "season"))
def q_fc_organic_fiscal(spark, d):
    return FC.organic_forecast(_points_and_short(spark, d, "fiscal"), calendar="fiscal")


@register("fc_bands", ("forecast_median", "forecast_high", "forecast_low"), ("step",))
def q_fc_bands(spark, d):
    return FC.organic_forecast(_points_and_short(spark, d)).select("series", "step", "forecast_low", "forecast_median",
                                                                   "forecast_high")


@register("fc_accuracy", ("r2", "mape_pct"))
def q_fc_accuracy(spark, d):
    pts, fit = _fit(spark, d)
    return FC.accuracy(pts, fit)


@register("fc_decompose", ("actual", "promo_effect", "baseline"), ("year",))
def q_fc_decompose(spark, d):
    pts, fit = _fit(spark, d)
    return FC.decompose(pts, fit)


from shelfscope.plans import regression as REG  # noqa: E402

PROMO_TYPES = {"tpr": "TPR", "display": "DSP"}
REGRESSORS = ("tpr", "display", "trend")


def _regressor_points(spark, d, calendar="month"):
    """Lines of each varietal with the promotion types (K0) that their product lists."""
    from shelfscope.sources.tables import read_table
    li = read_table(spark, d, "lineitem", ["l_partkey", "l_quantity", "l_shipdate"])
    part = proxy.raw_attributes(spark, d).select("p_partkey", F.col("code").alias("global_code"), "varietal", "promos_list_this_year")
    flags = REG.promo_flags(ETL.promo_codes(part), PROMO_TYPES)
    products = part.select("p_partkey", "global_code", "varietal").join(flags, "global_code", "left")
    return REG.regressor_points(li.join(products, li.l_partkey == products.p_partkey), "varietal", "l_shipdate", "l_quantity",
                                tuple(PROMO_TYPES), calendar)


@register("fc_ols_regressors", (*(f"{a}_{c}" for a in ("coef", "se") for c in REGRESSORS), "resid_se", "r2"), ("n", "seasons", "used"))
def q_fc_ols_regressors(spark, d):
    return REG.fit(_regressor_points(spark, d), REGRESSORS)


@register("fc_organic_regressors", ("forecast_median", "forecast_high", "forecast_low"), ("step", "season"))
def q_fc_organic_regressors(spark, d):
    return REG.organic_forecast(_regressor_points(spark, d, "fiscal"), tuple(PROMO_TYPES), calendar="fiscal")


@register("fc_bands_small_sample", ("forecast_median", "forecast_high", "forecast_low"), ("step", "season"))
def q_fc_bands_small_sample(spark, d):
    """90 % prediction intervals with the quantile of Student's t and the leverage of each step."""
    return REG.organic_forecast(_regressor_points(spark, d), tuple(PROMO_TYPES), confidence=0.9)


from shelfscope.plans import backtest as BT  # noqa: E402


@register("fc_backtest", ("mape_pct", "r2"), ("targets",))
def q_fc_backtest(spark, d):
    return BT.backtest(_points(spark, d))


@register("fc_backtest_steps", ("mape_pct", "r2"), ("targets", "step"))
def q_fc_backtest_steps(spark, d):
    return BT.backtest_steps(_points(spark, d, "fiscal"), calendar="fiscal")


@register("fc_promo_activations", ("actual", "baseline", "lift_pct", "gap_before", "gap_after"))
def q_fc_promo_activations(spark, d):
    return BT.activations(_points(spark, d))


@register("fc_promo_activation_lift", ("mean_lift_pct", "pooled_lift_pct"), ("activations",))
def q_fc_promo_activation_lift(spark, d):
    return BT.activation_lift(_points(spark, d))


# ------------------------------------------------- period roll-up, rejected rows

from shelfscope.sources import rollup as RU  # noqa: E402

#: The proxy's anchor one period back.
PREVIOUS_ANCHOR = "2001M09"


@register("market_base_rolled", BASE_D)
def q_market_base_rolled(spark, d):
    """The outlook's base from last period's sums, moved on by one period."""
    rows = RU.period_rollup(proxy.calc_sales(spark, d))
    old, new = {"M": PREVIOUS_ANCHOR}, {"M": proxy.MONTHLY_ANCHOR}
    state = RU.rolled_forward(RU.year_state(rows, old), rows, old, new)
    return RU.base_of_state(state, proxy.varietal_dim(spark, d), P)


@register("market_outlook_rollup", OUTLOOK_DOUBLES, OUTLOOK_INTS)
def q_market_outlook_rollup(spark, d):
    """The report from sums by brand and period in place of the fact's lines."""
    rows = RU.period_rollup(proxy.calc_sales(spark, d, window=True))
    return outlook.market_outlook(rows, proxy.report_periods(spark), proxy.varietal_dim(spark, d), P)


@register("dq_rejected_rows", (), ("rows",))
def q_dq_rejected_rows(spark, d):
    """Raw files as text with bad values by fixed rules: accepted rows and rejections by reason."""
    from shelfscope.sources.tables import RAW_ATTRIBUTES, checked, wide_schema
    labels = proxy.wide_labels("M")
    raw = _raw(spark, d, "M")
    key = F.col("code").cast("long")
    text = raw.select("province_code", *[F.col(c).cast("string").alias(c) for c in (*RAW_ATTRIBUTES, *labels)]).withColumns({
        labels[0]: F.when(key % 7 == 0, "n/a").otherwise(F.col(labels[0])),
        "units_per_case": F.when(key % 11 == 0, "12x").otherwise(F.col("units_per_case")),
        "code": F.when(key % 13 == 0, "  ").otherwise(F.col("code"))})
    accepted, rejected = checked(text, wide_schema(RAW_ATTRIBUTES, labels))
    return accepted.agg(F.lit("accepted").alias("reason"), F.count(F.lit(1)).alias("rows")).unionByName(
        rejected.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("rows")))

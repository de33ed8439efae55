"""name -> DuckDB SQL for every registered query that has an SQL formulation."""

from __future__ import annotations

from oracle import outlook_sql as MO
from oracle import reports_sql as R
from oracle.proxy_sql import with_base

SQL: dict[str, str] = {}

# ----------------------------------------------------------- market outlook
_MO = MO.outlook_chain()
SQL["market_outlook"] = with_base(_MO + MO.FINAL_SELECT)
SQL["market_outlook_format"] = with_base(MO.outlook_chain(3000) + MO.FINAL_SELECT)
SQL["market_base"] = with_base(MO.base_cte() + "\nSELECT * FROM mo_base")
SQL["market_base_untidy"] = SQL["market_base_rolled"] = SQL["market_base"]
SQL["market_outlook_rollup"] = SQL["market_outlook"]
SQL["market_share_rank"] = with_base(MO.base_cte() + MO.RANK_CTE + "\nSELECT * FROM mo_rank")
SQL["win_share"] = with_base(MO.base_cte() + MO.RANK_CTE +
                             "\nSELECT province_code, varietal, brand, market_share_ly, market_share_ty FROM mo_rank")
SQL["win_running_share"] = with_base(MO.base_cte() + MO.RANK_CTE +
                                     "\nSELECT province_code, varietal, brand, sale_vol_ty, cum_market_share_ty FROM mo_rank")
SQL["win_lag_cum"] = with_base(_MO + "\nSELECT province_code, varietal, brand, cum_market_share_ty, lag_cum_market_share FROM mo_lag")
SQL["market_tiers"] = with_base(_MO + "\nSELECT * FROM mo_seg")
SQL["market_concentration"] = with_base(_MO + "\nSELECT province_code, varietal, hhi_ly, hhi_ty, cr3, cr5, cr10 FROM mo_kpi")
SQL["hhi_segment"] = with_base(_MO + "\nSELECT province_code, varietal, hhi_ty, hhi_segment FROM (" + MO.FINAL_SELECT + ") f")
SQL["market_performance"] = with_base(
    _MO + "\nSELECT province_code, varietal, total_market_sale_ty, total_active_brands, market_yoy_change FROM mo_kpi")
SQL["focal_kpis"] = with_base(_MO + """
SELECT province_code, varietal, focal_rank_by_volume, focal_tier_by_volume, focal_total_sale_ty,
       focal_yoy_sale_change, focal_market_share_ly, focal_market_share_ty, focal_market_share_growth FROM mo_kpi""")
SQL["tier_kpis"] = with_base(_MO + """
SELECT province_code, varietal, tier_1_yoy_change, tier_2_yoy_change, tier_3_yoy_change,
       tier_1_market_share_change, tier_2_market_share_change, tier_3_market_share_change,
       tier_1_brands_count, tier_2_brands_count, tier_3_brands_count FROM mo_kpi""")
SQL["archetype"] = with_base(_MO + """
SELECT province_code, varietal, focal_archetype_position, focal_archetype_1st_part, focal_archetype_2nd_part
FROM (""" + MO.FINAL_SELECT + ") f")
SQL["filter_portfolio"] = with_base("""
SELECT province_code, varietal, brand, origin, period_code, relative_year, sale_9l_case, revenue
FROM calc_sales JOIN periods USING (period_code) JOIN varietals USING (varietal)
WHERE (upper(origin), if(upper(origin) = 'AMERICA', CAST(in_portfolio AS VARCHAR), varietal)) IN (('AMERICA', '1'), ('EUROPE', 'PROMO'))""")
SQL["agg_rolling_year"] = with_base(f"""
SELECT province_code, varietal, origin, {R.SUMS}, sum(revenue) FILTER (NOT now) AS revenue_ly,
       sum(revenue) FILTER (now) AS revenue_ty FROM {R.FLAGGED.format(how="")} GROUP BY ALL""")
SQL["win_topn"] = with_base(MO.base_cte() + """
SELECT province_code, varietal, brand, sale_vol_ty AS sale_ty,
       row_number() OVER (PARTITION BY province_code, varietal ORDER BY sale_vol_ty DESC NULLS LAST, brand) AS rn
FROM mo_base QUALIFY rn <= 3""")

# ----------------------------------------------------------------- flagship
_FL = R.FL_BASE + R.FL_SKU + R.FL_CUM
SQL["flagship_base"] = with_base(R.FL_BASE + """
SELECT province_code, varietal, unit_size, brand, product_code, product_name, retail_price, price_segment,
       sale_ly, sale_ty, revenue_ly, revenue_ty FROM fl_base""")
SQL["flagship_sku"] = with_base(R.FL_BASE + R.FL_SKU + "\nSELECT * FROM fl_sku")
SQL["brand_cutoff"] = with_base(_FL + R.FL_CUTOFF)
SQL["flagship_pricing"] = with_base(_FL + R.FL_FINAL)
SQL["filter_origin_exception"] = with_base("""
SELECT province_code, varietal, unit_size, brand, product_code, origin, period_code, sale_9l_case FROM calc_sales
WHERE CASE upper(origin) WHEN 'AMERICA' THEN true WHEN 'EUROPE' THEN varietal = 'PROMO' ELSE false END""")

# ------------------------------------------------------- varietal benchmark
SQL["agg_origin_level"] = with_base(R.VB_BASE + "\nSELECT * FROM vb_origin")
SQL["agg_varietal_level"] = with_base(R.VB_BASE + "\nSELECT * FROM vb_varietal")
SQL["varietal_performance"] = with_base(R.VB_BASE + R.VB_PERF + "\nSELECT * FROM vb_perf")
SQL["top_origin"] = with_base(R.VB_BASE + R.VB_TOP_ORIGIN + "\nSELECT * FROM vb_top_origin")
SQL["agg_argmax_pivot"] = with_base(R.VB_BASE + R.VB_TOP_ORIGIN + """
SELECT province_code, varietal, top_origin, top_origin_volume_sale, top_origin_volume_growth_yoy,
       top_origin_market_share FROM vb_top_origin""")
SQL["origin_stats"] = with_base(R.VB_BASE + R.VB_TOP_ORIGIN + """
SELECT province_code, varietal, home_origin_volume_sale, home_origin_volume_growth_yoy, home_origin_market_share
FROM vb_top_origin""")
SQL["market_leader"] = with_base(R.VB_BASE + R.VB_LEADER + "\nSELECT * FROM vb_leader")
SQL["origin_leader"] = with_base(R.VB_BASE + R.VB_HOME + "\nSELECT * FROM vb_home")
SQL["varietal_benchmark"] = with_base(R.VB_CHAIN + R.VB_FINAL)
SQL["filter_format"] = with_base("""
SELECT province_code, varietal, unit_size, SUM(sale_9l_case) AS sale_9l_case
FROM calc_sales WHERE unit_size = 750 GROUP BY province_code, varietal, unit_size""")

# ------------------------------------------------------------------- top-N
SQL["top3_sku"] = with_base(R.TS_BASE + R.TS_FINAL)
SQL["join_period_left"] = with_base(R.TS_BASE + "\nSELECT * FROM ts_base")

# --------------------------------------------------------- conformed layer
SQL["conf_sales_view"] = with_base("\nSELECT * FROM calc_sales")

_FISCAL_LABEL = """printf('%04dP%02d', fy, CAST(least(13, floor(datediff('day', make_date(fy, 4, 1), d) / 28) + 1) AS INTEGER))"""
SQL["dim_period_analogy"] = f"""
WITH d AS (SELECT CAST(l_shipdate AS DATE) AS d FROM lineitem),
f AS (SELECT d, CASE WHEN d < make_date(year(d), 4, 1) THEN year(d) - 1 ELSE year(d) END AS fy FROM d),
labels AS (
  SELECT DISTINCT strftime(d, '%YM%m') AS period_code FROM d
  UNION
  SELECT DISTINCT {_FISCAL_LABEL} AS period_code FROM f),
o AS (
  SELECT period_code, substr(period_code, 5, 1) AS kind,
         CAST(substr(period_code, 6, 2) AS INTEGER) AS season,
         CASE WHEN substr(period_code, 5, 1) = 'P' THEN 13 ELSE 12 END AS per_year,
         CASE WHEN substr(period_code, 5, 1) = 'P' THEN 2001 * 13 + 8 ELSE 2001 * 12 + 10 END
           - (CAST(substr(period_code, 1, 4) AS INTEGER) * CASE WHEN substr(period_code, 5, 1) = 'P' THEN 13 ELSE 12 END
              + CAST(substr(period_code, 6, 2) AS INTEGER)) AS dist
  FROM labels)
SELECT period_code,
       CASE WHEN dist >= 0 AND dist < per_year THEN 'TRY' ELSE 'LRY' END AS relative_year,
       season,
       CASE WHEN kind = 'P' THEN 'fiscal' ELSE 'monthly' END AS calendar
FROM o WHERE dist >= 0 AND dist < 2 * per_year"""
SQL["conf_fiscal_period"] = f"""
WITH f AS (SELECT CAST(l_shipdate AS DATE) AS d, l_quantity,
                  CASE WHEN CAST(l_shipdate AS DATE) < make_date(year(l_shipdate), 4, 1)
                       THEN year(l_shipdate) - 1 ELSE year(l_shipdate) END AS fy FROM lineitem)
SELECT {_FISCAL_LABEL} AS fiscal_period, COUNT(*) AS lines, SUM(l_quantity) AS quantity
FROM f GROUP BY 1"""
SQL["filter_origin"] = with_base("""
SELECT province_code, varietal, origin, COUNT(*) AS lines, SUM(sale_9l_case) AS sale_9l_case
FROM calc_sales WHERE UPPER(origin) = UPPER('america') GROUP BY province_code, varietal, origin""")

# ---------------------------------------------------------------------- ETL
from oracle import etl_sql  # noqa: E402

SQL.update(etl_sql.SQL)
SQL["conf_sales_view_etl"] = etl_sql.with_etl(etl_sql.VIEW_CTE + "\nSELECT * FROM calc_sales", products=True)
SQL["market_outlook_etl"] = etl_sql.with_etl(
    etl_sql.VIEW_CTE + MO.outlook_chain(home="NATION_6", varietal="Promo", other="NATION_7") + MO.FINAL_SELECT, products=True)
SQL["market_outlook_collated"] = SQL["market_outlook_etl"]

# ------------------------------------------------------- insights, forecast
from oracle import backtest_sql, insights_sql, regression_sql, seasons_sql  # noqa: E402

SQL.update(seasons_sql.SQL)
SQL.update(regression_sql.SQL)
SQL.update(backtest_sql.SQL)

SQL.update(insights_sql.SQL)
SQL["ins_price_volume"] = with_base(_FL + """
SELECT province_code, varietal, unit_size, brand, product_code, retail_price, price_segment, sale_ty
FROM (""" + R.FL_FINAL + ") f")

"""Insight metrics and organic forecast in DuckDB SQL."""

from __future__ import annotations

from oracle.proxy_sql import with_base

_SP = "calc_sales s JOIN periods a ON s.period_code = a.period_code"


def _lyty(v: str = "s.sale_9l_case") -> str:
    return (f"SUM(CASE WHEN a.relative_year = 'LRY' THEN {v} END) AS sale_ly, "
            f"SUM(CASE WHEN a.relative_year = 'TRY' THEN {v} END) AS sale_ty")


def _yoy(ty: str, ly: str) -> str:
    return f"COALESCE(CAST({ty} - {ly} AS DOUBLE) * 100.0 / NULLIF(CAST({ly} AS DOUBLE), 0), 0)"


SQL: dict[str, str] = {}

SQL["ins_national_trend"] = with_base(f""",
t AS (SELECT
  SUM(CASE WHEN a.relative_year = 'LRY' THEN s.sale_9l_case END) AS market_ly,
  SUM(CASE WHEN a.relative_year = 'TRY' THEN s.sale_9l_case END) AS market_ty,
  SUM(CASE WHEN a.relative_year = 'LRY' AND UPPER(s.brand) = 'BRAND#7' THEN s.sale_9l_case END) AS focal_ly,
  SUM(CASE WHEN a.relative_year = 'TRY' AND UPPER(s.brand) = 'BRAND#7' THEN s.sale_9l_case END) AS focal_ty
  FROM {_SP})
SELECT market_ly, market_ty, market_ty - market_ly AS market_change, {_yoy('market_ty', 'market_ly')} AS market_yoy_pct,
       focal_ly, focal_ty, {_yoy('focal_ty', 'focal_ly')} AS focal_yoy_pct FROM t""")

SQL["ins_national_rank"] = with_base(f""",
b AS (SELECT s.brand, {_lyty()} FROM {_SP} WHERE UPPER(s.origin) = 'AMERICA' GROUP BY s.brand)
SELECT brand, sale_ly, sale_ty, {_yoy('sale_ty', 'sale_ly')} AS yoy_pct,
       ROW_NUMBER() OVER (ORDER BY sale_ty DESC NULLS LAST, brand ASC) AS national_rank FROM b""")

SQL["ins_per_capita"] = with_base(f""",
pop AS (SELECT cr.r_name AS province_code, COUNT(*) AS population
        FROM customer c JOIN nr cr ON c.c_nationkey = cr.n_nationkey GROUP BY cr.r_name),
b AS (SELECT s.province_code, {_lyty()} FROM {_SP} GROUP BY s.province_code),
pc AS (SELECT b.province_code, b.sale_ty, p.population,
              CAST(b.sale_ty AS DOUBLE) / NULLIF(CAST(p.population AS DOUBLE), 0) AS per_capita
       FROM b JOIN pop p ON b.province_code = p.province_code)
SELECT province_code, sale_ty, population, per_capita,
       per_capita / NULLIF((SELECT MAX(per_capita) FROM pc WHERE province_code = 'AMERICA'), 0) AS ratio_to_reference
FROM pc""")

SQL["ins_region_mix"] = with_base(f""",
f AS (SELECT s.province_code, {_lyty()} FROM {_SP} WHERE UPPER(s.brand) = 'BRAND#7' GROUP BY s.province_code)
SELECT province_code, sale_ty,
       COALESCE(CAST(sale_ty AS DOUBLE) * 100.0 / NULLIF(CAST((SELECT SUM(sale_ty) FROM f) AS DOUBLE), 0), 0)
         AS share_of_focal_pct
FROM f""")

_HOME = f""",
hb AS (SELECT s.province_code, s.varietal, s.brand, {_lyty()} FROM {_SP}
       WHERE UPPER(s.origin) = 'AMERICA' GROUP BY s.province_code, s.varietal, s.brand),
hm AS (SELECT *, {_yoy('sale_ty', 'sale_ly')} AS yoy_pct,
         COALESCE(CAST(sale_ty AS DOUBLE) * 100.0
                  / NULLIF(CAST(SUM(sale_ty) OVER (PARTITION BY province_code, varietal) AS DOUBLE), 0), 0) AS share_pct,
         ROW_NUMBER() OVER (PARTITION BY province_code, varietal
                            ORDER BY sale_ty DESC NULLS LAST, sale_ly DESC NULLS LAST, brand ASC) AS rank
       FROM hb)"""

SQL["ins_challengers"] = with_base(_HOME + """,
hl AS (SELECT *, MAX(CASE WHEN rank = 1 THEN brand END) OVER (PARTITION BY province_code, varietal) AS leader_brand,
              MAX(CASE WHEN rank = 1 THEN yoy_pct END) OVER (PARTITION BY province_code, varietal) AS leader_yoy_pct
       FROM hm)
SELECT province_code, varietal, leader_brand, leader_yoy_pct, brand, rank, yoy_pct, share_pct
FROM hl WHERE rank > 1 AND yoy_pct > leader_yoy_pct""")

SQL["ins_consistent_rank"] = with_base(_HOME + """
SELECT varietal, brand, COUNT(*) AS provinces, MIN(rank) AS min_rank, MAX(rank) AS max_rank,
       CAST(MIN(rank) = MAX(rank) AS INTEGER) AS same_rank_everywhere,
       CAST(COALESCE(bool_and(sale_ty < sale_ly), false) AS INTEGER) AS declining_everywhere
FROM hm GROUP BY varietal, brand""")

SQL["ins_format_share"] = with_base(f""",
b AS (SELECT s.province_code, s.varietal, s.unit_size, {_lyty()} FROM {_SP}
      GROUP BY s.province_code, s.varietal, s.unit_size)
SELECT province_code, varietal, unit_size, sale_ty,
       COALESCE(CAST(sale_ty AS DOUBLE) * 100.0
                / NULLIF(CAST(SUM(sale_ty) OVER (PARTITION BY province_code, varietal) AS DOUBLE), 0), 0)
         AS format_share_pct
FROM b""")

SQL["ins_format_leader"] = with_base(f""",
b AS (SELECT s.province_code, s.varietal, s.unit_size, s.brand, {_lyty()} FROM {_SP}
      GROUP BY s.province_code, s.varietal, s.unit_size, s.brand),
r AS (SELECT *, COALESCE(CAST(sale_ty AS DOUBLE) * 100.0 / NULLIF(CAST(SUM(sale_ty) OVER
                  (PARTITION BY province_code, varietal, unit_size) AS DOUBLE), 0), 0) AS leader_share_pct,
             ROW_NUMBER() OVER (PARTITION BY province_code, varietal, unit_size
                                ORDER BY sale_ty DESC NULLS LAST, sale_ly DESC NULLS LAST, brand ASC) AS rn
      FROM b)
SELECT province_code, varietal, unit_size, brand AS leader_brand, sale_ty, leader_share_pct FROM r WHERE rn = 1""")

SQL["ins_portfolio_gap"] = with_base(f""",
m AS (SELECT s.province_code, s.varietal, s.unit_size, {_lyty()} FROM {_SP}
      WHERE UPPER(s.origin) = 'AMERICA' GROUP BY s.province_code, s.varietal, s.unit_size),
f AS (SELECT s.province_code, s.varietal, s.unit_size, {_lyty()} FROM {_SP}
      WHERE UPPER(s.origin) = 'AMERICA' AND UPPER(s.brand) = 'BRAND#7'
      GROUP BY s.province_code, s.varietal, s.unit_size)
SELECT m.province_code, m.varietal, m.unit_size, m.sale_ty AS market_volume_ty,
       ROW_NUMBER() OVER (PARTITION BY m.province_code
                          ORDER BY m.sale_ty DESC NULLS LAST, m.varietal ASC, m.unit_size ASC) AS gap_rank
FROM m WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.sale_ty > 0 AND f.province_code = m.province_code
                         AND f.varietal = m.varietal AND f.unit_size = m.unit_size)""")

SQL["ins_price_histogram"] = with_base("\nSELECT price_segment, COUNT(*) AS products FROM products GROUP BY price_segment")

# ------------------------------------------------------------------ forecast
POINTS = """
WITH g AS (
  SELECT p.p_type AS series, CAST(date_trunc('month', l.l_shipdate) AS DATE) AS period_start,
         CAST(SUM(l.l_quantity) AS DOUBLE) AS y,
         SUM(CAST(round(l.l_discount * 100.0) AS BIGINT)) AS pts, COUNT(*) AS n
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
  GROUP BY 1, 2),
pts AS (SELECT series, period_start, month(period_start) AS season, year(period_start) AS year, y,
               CASE WHEN pts >= n * 5 THEN 1.0 ELSE 0.0 END AS promo FROM g),
dm AS (SELECT *, AVG(y) OVER (PARTITION BY series, season) AS y_season_mean,
              AVG(promo) OVER (PARTITION BY series, season) AS promo_season_mean FROM pts),
dm2 AS (SELECT *, y - y_season_mean AS y_dm, promo - promo_season_mean AS x_dm FROM dm),
agg AS (SELECT series, SUM(x_dm * y_dm) AS sxy, SUM(x_dm * x_dm) AS sxx, SUM(y_dm * y_dm) AS syy,
               COUNT(*) AS n, COUNT(DISTINCT season) AS seasons FROM dm2 GROUP BY series),
fit AS (SELECT series, n, seasons, COALESCE(sxy / NULLIF(sxx, 0.0), 0.0) AS promo_slope, sxy, syy FROM agg),
fit2 AS (SELECT series, n, seasons, promo_slope,
                sqrt(greatest(syy - promo_slope * sxy, 0.0) / NULLIF(CAST(n - seasons - 1 AS DOUBLE), 0.0)) AS resid_se
         FROM fit),
fitted AS (SELECT d.*, d.y - (d.y_season_mean + f.promo_slope * d.x_dm) AS resid
           FROM dm2 d JOIN fit2 f ON d.series = f.series)
"""

SQL["fc_promo_lift"] = POINTS + """
SELECT series, AVG(CASE WHEN promo = 1.0 THEN y END) AS avg_promoted, AVG(CASE WHEN promo = 0.0 THEN y END) AS avg_unpromoted,
       COUNT(CASE WHEN promo = 1.0 THEN 1 END) AS promoted_periods,
       (AVG(CASE WHEN promo = 1.0 THEN y END) / NULLIF(AVG(CASE WHEN promo = 0.0 THEN y END), 0.0) - 1.0) * 100.0 AS lift_pct
FROM pts GROUP BY series"""
SQL["fc_ols_fit"] = POINTS + "SELECT * FROM fit2"


def forecast_sql(columns: str, fiscal: bool = False) -> str:
    """Thirteen steps for each series and its first-half copy; an unseen season gives NULLs."""
    n = 13 if fiscal else 12
    points = f"""
WITH days AS (SELECT p.p_type AS series, CAST(l.l_shipdate AS DATE) AS d, l.l_quantity, l.l_discount
              FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
fy AS (SELECT *, CASE WHEN d < make_date(year(d), 4, 1) THEN year(d) - 1 ELSE year(d) END AS fy FROM days),
numbered AS (SELECT *, {'fy * 13 + least(13, datediff(' + "'day'" + ', make_date(fy, 4, 1), d) // 28 + 1) - 1' if fiscal
                  else 'year(d) * 12 + month(d) - 1'} AS no FROM fy),
one AS (SELECT series, no, no % {n} + 1 AS season, CAST(sum(l_quantity) AS DOUBLE) AS y,
               CAST(sum(CAST(round(l_discount * 100.0) AS BIGINT)) >= 5 * count(*) AS INTEGER) * 1.0 AS promo FROM numbered GROUP BY ALL),
pts AS (FROM one UNION ALL SELECT series || ' (H1)', no, season, y, promo FROM one WHERE season <= 6),
means AS (SELECT series, season, avg(y) AS my, avg(promo) AS mp, count(*) AS n FROM pts GROUP BY ALL),
fit AS (SELECT series, sum((promo - mp) * (y - my)) AS sxy, sum((promo - mp) * (promo - mp)) AS sxx, sum((y - my) * (y - my)) AS syy,
               count(*) - count(DISTINCT season) - 1 AS dof, max(no) AS last
        FROM pts JOIN means USING (series, season) GROUP BY ALL),
slope AS (SELECT series, last, COALESCE(sxy / NULLIF(sxx, 0), 0) AS b, syy - COALESCE(sxy / NULLIF(sxx, 0), 0) * sxy AS sse, dof FROM fit),
ahead AS (SELECT *, last + step AS no, CAST((last + step) % {n} + 1 AS INTEGER) AS season
          FROM slope CROSS JOIN (SELECT unnest(range(1, 14)) AS step)),
fc AS (SELECT a.series, a.step, a.season, {"printf('%04dP%02d', a.no // 13, a.season)" if fiscal else "printf('%04d-%02d', a.no // 12, a.season)"} AS target_period,
              my - b * mp AS forecast_median, 1.6448536269514722 * COALESCE(sqrt(greatest(sse, 0) / NULLIF(CAST(dof AS DOUBLE), 0)), 0) AS band
       FROM ahead a LEFT JOIN means m ON m.series = a.series AND m.season = a.season)"""
    return points + f"""
SELECT {columns} FROM (SELECT *, forecast_median - band AS forecast_low, forecast_median + band AS forecast_high FROM fc)"""


SQL["fc_organic"] = forecast_sql("series, step, target_period, season, forecast_median")
SQL["fc_organic_fiscal"] = forecast_sql(
    "series, step, target_period, season, forecast_median, forecast_high, forecast_low", fiscal=True)
SQL["fc_bands"] = forecast_sql("series, step, forecast_low, forecast_median, forecast_high")
SQL["fc_accuracy"] = POINTS + """,
ym AS (SELECT *, AVG(y) OVER (PARTITION BY series) AS y_mean FROM fitted)
SELECT series, 1.0 - SUM(resid * resid) / NULLIF(SUM((y - y_mean) * (y - y_mean)), 0.0) AS r2,
       AVG(CASE WHEN y > 0 THEN abs(resid) / y END) * 100.0 AS mape_pct
FROM ym GROUP BY series"""
SQL["fc_decompose"] = POINTS + """
SELECT p.series, p.year, SUM(p.y) AS actual, SUM(f.promo_slope * p.promo) AS promo_effect,
       SUM(p.y) - SUM(f.promo_slope * p.promo) AS baseline
FROM pts p JOIN fit2 f ON p.series = f.series GROUP BY p.series, p.year"""

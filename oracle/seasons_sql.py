"""Seasons across calendars in DuckDB SQL, from a table of days: a label is the set of its
days, an overlap is a count of days, and a part is the difference of two running shares."""

from __future__ import annotations

from oracle.etl_sql import SALES_CTE, VIEW_CTE, with_etl

DAYS = """,
days AS (
  SELECT d, strftime(d, '%YM%m') AS month,
         printf('%04dP%02d', fy, CAST(least(13, date_diff('day', make_date(fy, 4, 1), d) // 28 + 1) AS INTEGER)) AS fiscal
  FROM (SELECT CAST(t AS DATE) AS d, year(t) - CAST(month(t) < 4 AS INTEGER) AS fy
        FROM (SELECT unnest(generate_series(TIMESTAMP '1990-01-01', TIMESTAMP '2010-12-31', INTERVAL 1 DAY)) AS t))),
labelled AS (SELECT month AS label, * FROM days UNION ALL SELECT fiscal AS label, * FROM days)"""


def shared(kind: str, name: str) -> str:
    """The days that labels share with the periods of one calendar."""
    return f""",
{name} AS (
  SELECT label AS period_code, {kind} AS season_code, count(*) AS days,
         sum(count(*)) OVER (PARTITION BY label ORDER BY {kind}) - count(*) AS days_before,
         sum(count(*)) OVER (PARTITION BY label) AS period_days
  FROM labelled GROUP BY label, {kind})"""


def part(amount: str) -> str:
    """What a period passes on: whole ten-thousandths, half away from zero."""
    units = f"CAST(abs({amount}) * 10000 AS HUGEINT)"

    def upto(days: str) -> str:
        return f"(({units} * {days} * 2 + period_days) // (2 * period_days))"

    return f"sign({amount}) * CAST({upto('(days_before + days)')} - {upto('days_before')} AS DECIMAL(28,0)) / 10000"


SPREAD = """,
summed AS (SELECT province_code, {keys}, period_code, sum(sale_9l_case) AS v, sum(revenue) AS r FROM calc_sales GROUP BY ALL),
spread AS (SELECT province_code, {keys}, season_code, {v} AS v, {r} AS r FROM summed JOIN shared_p USING (period_code))"""


def spread(keys: str) -> str:
    return DAYS + shared("fiscal", "shared_p") + SPREAD.format(keys=keys, v=part("v"), r=part("r"))


SQL = {
    "dim_period_overlap": with_etl(SALES_CTE + DAYS + shared("fiscal", "shared_p") + shared("month", "shared_m") + """,
used AS (SELECT DISTINCT sale_period AS period_code FROM sales)
SELECT period_code, season_code, days_before, days, period_days FROM shared_p SEMI JOIN used USING (period_code)
UNION ALL SELECT period_code, season_code, days_before, days, period_days FROM shared_m SEMI JOIN used USING (period_code)"""),
    "conf_season_sales": with_etl(VIEW_CTE + spread("product_code") + """
SELECT province_code, product_code, season_code, sum(v) AS sale_9l_case, sum(r) AS revenue FROM spread GROUP BY ALL""", products=True),
    "ins_season_comparison": with_etl(VIEW_CTE + spread("varietal") + """,
covered AS (SELECT province_code, season_code, sum(days) AS n
            FROM (SELECT DISTINCT province_code, period_code FROM calc_sales) JOIN shared_p USING (period_code) GROUP BY ALL),
numbered AS (SELECT province_code, varietal, season_code, sum(v) AS v, any_value(n) AS n,
                    2001 * 13 + 8 - CAST(season_code[1:4] AS INTEGER) * 13 - CAST(season_code[6:] AS INTEGER) AS back,
                    CAST(season_code[6:] AS INTEGER) AS season
             FROM spread JOIN covered USING (province_code, season_code) GROUP BY ALL),
rates AS (SELECT province_code, varietal, season, sum(v) FILTER (back < 13) AS v, sum(n) FILTER (back < 13) AS n,
                 sum(v) FILTER (back >= 13) AS vl, sum(n) FILTER (back >= 13) AS nl
          FROM numbered WHERE back BETWEEN 0 AND 25 GROUP BY ALL),
whole AS (SELECT province_code, varietal, CAST(sum(v) AS DOUBLE) / sum(n) AS average FROM rates GROUP BY ALL),
indexed AS (SELECT *, CAST(v AS DOUBLE) / n AS rate_ty, CAST(vl AS DOUBLE) / nl AS rate_ly,
                   COALESCE(CAST(v AS DOUBLE) / n * 100 / NULLIF(average, 0), 0) AS season_index FROM rates JOIN whole USING (province_code, varietal)),
mean AS (SELECT varietal, season, avg(season_index) AS mean FROM indexed GROUP BY ALL)
SELECT province_code, varietal, season, rate_ly, rate_ty, COALESCE((rate_ty - rate_ly) * 100 / NULLIF(rate_ly, 0), 0) AS rate_change_pct,
       season_index, season_index - mean AS index_gap
FROM indexed JOIN mean USING (varietal, season)""", products=True),
}

"""Rolling origins in DuckDB SQL by refitting on the points up to each origin, and activations
by looking up the nearest unpromoted periods."""

from __future__ import annotations


def points(fiscal: bool = False) -> str:
    no = "fy * 13 + least(13, datediff('day', make_date(fy, 4, 1), d) // 28 + 1) - 1" if fiscal else "year(d) * 12 + month(d) - 1"
    return f"""
WITH days AS (SELECT p.p_type AS series, CAST(l.l_shipdate AS DATE) AS d, l.l_quantity, l.l_discount,
                     year(l.l_shipdate) - CAST(month(l.l_shipdate) < 4 AS INTEGER) AS fy
              FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
pts AS (SELECT series, {no} AS no, ({no}) % {13 if fiscal else 12} AS season, sum(l_quantity)::DOUBLE AS y,
               (sum(CAST(round(l_discount * 100.0) AS BIGINT)) >= 5 * count(*))::INT::DOUBLE AS x FROM days GROUP BY ALL)"""


def refitted(year: int) -> str:
    return f""",
known AS (SELECT o.series, o.no AS origin, p.season, p.y, p.x, avg(p.y) OVER s AS my, avg(p.x) OVER s AS mx
          FROM pts o JOIN pts p ON p.series = o.series AND p.no <= o.no WINDOW s AS (PARTITION BY o.series, o.no, p.season)),
models AS (SELECT series, origin, count(*) AS n, count(DISTINCT season) AS seasons,
                  CASE WHEN sum((x - mx) * (x - mx)) > 1e-9 THEN sum((x - mx) * (y - my)) / sum((x - mx) * (x - mx)) ELSE 0 END AS slope
           FROM known GROUP BY ALL),
means AS (SELECT DISTINCT series, origin, season, my, mx FROM known),
ahead AS (SELECT m.series, m.origin, t.no - m.origin AS step, t.y, my + slope * (t.x - mx) AS y_hat
          FROM models m JOIN pts t ON t.series = m.series AND t.no BETWEEN m.origin + 1 AND m.origin + {year}
          JOIN means k ON k.series = m.series AND k.origin = m.origin AND k.season = t.season
          WHERE n >= {2 * year} AND n - seasons > 1)"""


MEASURES = """count(*) AS targets, 100 * avg(abs(y - y_hat) / y) FILTER (y > 0) AS mape_pct,
       CASE WHEN count(*) > 1 AND var_pop(y) > 0 THEN 1 - sum(power(y - y_hat, 2)) / (count(*) * var_pop(y)) END AS r2"""

ACTIVATIONS = points() + """,
plain AS (SELECT * FROM pts WHERE x = 0),
found AS (SELECT t.*, b.no AS b_no, b.y AS b_y, a.no AS a_no, a.y AS a_y
          FROM (SELECT *, no - 1 AS earlier, no + 1 AS later FROM pts WHERE x = 1) t
          ASOF LEFT JOIN plain b ON b.series = t.series AND t.earlier >= b.no
          ASOF LEFT JOIN plain a ON a.series = t.series AND t.later <= a.no),
acts AS (SELECT series, no, y AS actual, no - b_no AS gap_before, a_no - no AS gap_after,
                CASE WHEN b_no IS NULL THEN a_y WHEN a_no IS NULL THEN b_y
                     ELSE b_y + (a_y - b_y) * (no - b_no) / (a_no - b_no) END AS baseline FROM found)"""

SQL = {
    "fc_backtest": points() + refitted(12) + f"""
SELECT series, printf('%04d-%02d', origin // 12, origin % 12 + 1) AS origin, {MEASURES} FROM ahead GROUP BY series, ahead.origin""",
    "fc_backtest_steps": points(fiscal=True) + refitted(13) + f"\nSELECT series, step, {MEASURES} FROM ahead GROUP BY series, step",
    "fc_promo_activations": ACTIVATIONS + """
SELECT series, printf('%04d-%02d', no // 12, no % 12 + 1) AS period, actual, baseline, gap_before, gap_after,
       (actual / NULLIF(baseline, 0) - 1) * 100 AS lift_pct FROM acts""",
    "fc_promo_activation_lift": ACTIVATIONS + """
SELECT series, count(*) AS activations, avg((actual / NULLIF(baseline, 0) - 1) * 100) AS mean_lift_pct,
       (sum(actual) FILTER (baseline IS NOT NULL) / NULLIF(sum(baseline), 0) - 1) * 100 AS pooled_lift_pct FROM acts GROUP BY series""",
}

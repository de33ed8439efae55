"""Several regressors in DuckDB SQL: each one's coefficient is y's slope on what the other
two and the seasons leave of it (residuals row by row, no normal equations)."""

from __future__ import annotations

import math

import numpy as np

NAMES = ("tpr", "display", "trend")


def points(fiscal: bool) -> str:
    no = "fy * 13 + least(13, datediff('day', make_date(fy, 4, 1), d) // 28 + 1) - 1" if fiscal else "year(d) * 12 + month(d) - 1"
    return f"""
WITH lines AS (SELECT p.p_type AS series, CAST(l.l_shipdate AS DATE) AS d, l.l_quantity AS q, p.p_partkey % 3 AS kind,
                      year(l.l_shipdate) - CAST(month(l.l_shipdate) < 4 AS INTEGER) AS fy
               FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
bare AS (SELECT series, {no} AS no, sum(q)::DOUBLE AS y, avg((kind < 2)::INT) AS tpr, avg((kind = 0)::INT) AS display FROM lines GROUP BY ALL),
pts AS (SELECT series, no, no % {13 if fiscal else 12} + 1 AS season, y, tpr, display,
               (no - min(no) OVER (PARTITION BY series))::DOUBLE AS trend FROM bare),
flat AS (SELECT series, no, {', '.join(f'{c} - avg({c}) OVER (PARTITION BY series, season) AS {c}' for c in ('y', *NAMES))} FROM pts)"""


def left_of(v: str, u: str, w: str) -> str:
    """What ``u`` and ``w`` leave of ``v``, and y's slope on it."""
    dot = "sum({} * {}) OVER (PARTITION BY series)"
    return f""",
{v}1 AS (SELECT *, {w} - {u} * {dot.format(w, u)} / {dot.format(u, u)} AS w1, {v} - {u} * {dot.format(v, u)} / {dot.format(u, u)} AS v1 FROM flat),
{v}2 AS (SELECT series, y, v1 - w1 * {dot.format('v1', 'w1')} / {dot.format('w1', 'w1')} AS r FROM {v}1),
{v}_fit AS (SELECT series, sum(y * r) / sum(r * r) AS coef_{v}, sqrt(sum(r * r)) AS size_{v} FROM {v}2 GROUP BY series)"""


def model(fiscal: bool = False) -> str:
    rest = [(v, *(x for x in NAMES if x != v)) for v in NAMES]
    return points(fiscal) + "".join(left_of(*r) for r in rest) + f""",
sums AS (SELECT series, count(*) AS n, count(DISTINCT season) AS seasons, sum((y - my) * (y - my)) AS sst
         FROM (SELECT *, avg(y) OVER (PARTITION BY series) AS my FROM pts) GROUP BY series),
coefs AS (SELECT * FROM sums {' '.join(f'JOIN {v}_fit USING (series)' for v in NAMES)}),
left_over AS (SELECT series, sum(power(f.y - {' - '.join(f'coef_{v} * f.{v}' for v in NAMES)}, 2)) AS sse
              FROM flat f JOIN coefs USING (series) GROUP BY series),
fit AS (SELECT c.*, sse, sqrt(sse / (n - seasons - 3)) AS resid_se FROM coefs c JOIN left_over USING (series))"""


def t95(dof: int) -> float:
    """The 95 % quantile of Student's t: Newton's method on the integrated density."""
    nodes, weights = np.polynomial.legendre.leggauss(80)
    scale = math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(dof * math.pi)

    def density(x):
        return scale * (1 + x * x / dof) ** (-(dof + 1) / 2)

    t = 1.6
    for _ in range(40):
        inside = float((weights * density((nodes + 1) * t / 2)).sum()) * t / 2
        t -= (inside - 0.45) / density(t)
    return t


QUANTILES = ", ".join(f"({v}, {t95(v)!r})" for v in range(4, 151))

#: The leverage of a step: its distance from the season's means along three orthogonal directions.
LEVERAGE = """,
dots AS (SELECT series, sum(tpr * tpr) AS aa, sum(display * tpr) / sum(tpr * tpr) AS ba, sum(trend * tpr) / sum(tpr * tpr) AS ca FROM flat GROUP BY series),
second AS (SELECT f.series, f.trend - ca * f.tpr AS c, f.display - ba * f.tpr AS b FROM flat f JOIN dots USING (series)),
more AS (SELECT series, sum(b * b) AS bb, sum(c * b) / sum(b * b) AS cb FROM second GROUP BY series),
third AS (SELECT series, sum(power(c - cb * b, 2)) AS cc FROM second JOIN more USING (series) GROUP BY series),
bases AS (SELECT * FROM dots JOIN more USING (series) JOIN third USING (series))"""

SQL = {
    "fc_ols_regressors": model() + f"""
SELECT series, n, seasons, 3 AS used, {', '.join(f'coef_{v}, resid_se / size_{v} AS se_{v}' for v in NAMES)}, resid_se, 1 - sse / sst AS r2 FROM fit""",
    "fc_organic_regressors": model(fiscal=True) + """,
means AS (SELECT series, season, avg(y) AS y, avg(tpr) AS tpr, avg(display) AS display, avg(trend) AS trend FROM pts GROUP BY ALL),
ends AS (SELECT series, min(no) AS first, max(no) AS last FROM pts GROUP BY ALL),
ahead AS (SELECT series, first, unnest(range(1, 14)) AS step, last FROM ends),
fc AS (SELECT a.series, step, printf('%04dP%02d', (last + step) // 13, CAST((last + step) % 13 + 1 AS INTEGER)) AS target_period,
              (last + step) % 13 + 1 AS season, 1.6448536269514722 * resid_se AS band,
              y - coef_tpr * tpr - coef_display * display + coef_trend * (last + step - first - trend) AS forecast_median
       FROM ahead a JOIN fit USING (series) LEFT JOIN means m ON m.series = a.series AND m.season = (last + step) % 13 + 1)
SELECT series, step, target_period, season, forecast_median, forecast_median + band AS forecast_high, forecast_median - band AS forecast_low FROM fc""",
    "fc_bands_small_sample": model() + LEVERAGE + f""",
quantiles(dof, t) AS (VALUES {QUANTILES}),
means AS (SELECT series, season, count(*) AS m, avg(y) AS y, avg(tpr) AS tpr, avg(display) AS display, avg(trend) AS trend FROM pts GROUP BY ALL),
ends AS (SELECT series, min(no) AS first, max(no) AS last FROM pts GROUP BY ALL),
ahead AS (SELECT series, first, unnest(range(1, 14)) AS step, last FROM ends),
away AS (SELECT a.*, m.y, m.m, -m.tpr AS d1, -m.display AS d2, last + step - first - m.trend AS d3, (last + step) % 12 + 1 AS season
         FROM ahead a LEFT JOIN means m ON m.series = a.series AND m.season = (last + step) % 12 + 1),
fc AS (SELECT w.series, step, printf('%04d-%02d', (last + step) // 12, CAST(season AS INTEGER)) AS target_period, season,
              y + coef_tpr * d1 + coef_display * d2 + coef_trend * d3 AS forecast_median,
              t * resid_se * sqrt(1 + 1.0 / m + d1 * d1 / aa + power(d2 - ba * d1, 2) / bb
                                  + power(d3 - ca * d1 - cb * (d2 - ba * d1), 2) / cc) AS band
       FROM away w JOIN fit USING (series) JOIN bases USING (series) JOIN quantiles ON dof = n - seasons - 3)
SELECT series, step, target_period, season, forecast_median, forecast_median + band AS forecast_high, forecast_median - band AS forecast_low FROM fc""",
}

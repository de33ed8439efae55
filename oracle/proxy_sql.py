"""Proxy-market CTEs in DuckDB SQL, mirroring ``shelfscope.sources.proxy``."""

from __future__ import annotations


def _month_labels(first_year: int, first_month: int, n: int) -> list[str]:
    out, y, m = [], first_year, first_month
    for _ in range(n):
        out.append(f"{y:04d}M{m:02d}")
        m += 1
        if m == 13:
            y, m = y + 1, 1
    return out


def _fiscal_labels(first_year: int, first_period: int, n: int) -> list[str]:
    out, y, p = [], first_year, first_period
    for _ in range(n):
        out.append(f"{y:04d}P{p:02d}")
        p += 1
        if p == 14:
            y, p = y + 1, 1
    return out


# Two rolling years per calendar: LRY then TRY (monthly 1999M11..2001M10,
# fiscal 1999P09..2001P08).
MONTHS = _month_labels(1999, 11, 24)
FISCAL = _fiscal_labels(1999, 9, 26)
PERIOD_ROWS = ([(x, "LRY" if i < 12 else "TRY", int(x[5:])) for i, x in enumerate(MONTHS)]
               + [(x, "LRY" if i < 13 else "TRY", int(x[5:])) for i, x in enumerate(FISCAL)])

BAND_ROWS = [(chr(ord("D") + i), 900.0 + 10 * i, 909.9 + 10 * i) for i in range(9)]


def _values(rows, fmt) -> str:
    return ",\n    ".join(fmt(r) for r in rows)


PERIODS_CTE = (
    "periods AS (SELECT * FROM (VALUES\n    "
    + _values(PERIOD_ROWS, lambda r: f"('{r[0]}', '{r[1]}', {r[2]})")
    + "\n  ) t(period_code, relative_year, season))"
)

BANDS_CTE = (
    "bands AS (SELECT price_segment, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi FROM (VALUES\n    "
    + _values(BAND_ROWS, lambda r: f"('{r[0]}', {r[1]:.1f}, {r[2]:.1f})")
    + "\n  ) t(price_segment, lo, hi))"
)

BASE_CTES = f"""
nr AS (SELECT n.n_nationkey, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey),
{BANDS_CTE},
products AS (
  SELECT p.p_partkey,
         CAST(p.p_partkey AS VARCHAR) AS global_code,
         p.p_name AS product_name,
         p.p_brand AS brand,
         p.p_type AS varietal,
         CASE WHEN p.p_size <= 10 THEN 375 WHEN p.p_size <= 35 THEN 750
              WHEN p.p_size <= 45 THEN 1500 ELSE 3000 END AS unit_size,
         p.p_retailprice AS retail_price_this_year,
         b.price_segment
  FROM part p LEFT JOIN bands b ON p.p_retailprice >= b.lo AND p.p_retailprice <= b.hi),
calc_sales AS (
  SELECT cr.r_name AS province_code, pr.varietal, pr.unit_size, pr.brand,
         pr.global_code AS product_code, pr.product_name, pr.price_segment,
         sr.r_name AS origin,
         strftime(l.l_shipdate, '%YM%m') AS period_code,
         CAST(l.l_quantity AS DECIMAL(18,4)) AS sale_9l_case,
         CAST(l.l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2))) AS revenue
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nr cr ON c.c_nationkey = cr.n_nationkey
  JOIN products pr ON l.l_partkey = pr.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nr sr ON s.s_nationkey = sr.n_nationkey),
{PERIODS_CTE},
varietals AS (
  SELECT DISTINCT p_type AS varietal,
         CASE WHEN p_type IN ('STANDARD', 'PROMO') THEN 0 ELSE 1 END AS in_portfolio
  FROM part),
provinces AS (SELECT r_name AS province_code, lower(r_name) AS province_name FROM region)
"""


def with_base(body: str) -> str:
    """Prefix a query whose own CTEs start with ``, name AS (...)``."""
    return "WITH " + BASE_CTES.strip() + "\n" + body


def wrap(sql: str, doubles=(), ints=()) -> str:
    """Output normalisation matching ``shelfscope.catalog.normalise``."""
    repl = [f"round(CAST(\"{c}\" AS DOUBLE) * 1e6) / 1e6 AS \"{c}\"" for c in doubles]
    repl += [f"CAST(\"{c}\" AS BIGINT) AS \"{c}\"" for c in ints]
    if not repl:
        return sql
    return f"SELECT * REPLACE ({', '.join(repl)}) FROM (\n{sql}\n) q"

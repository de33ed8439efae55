"""ETL queries in DuckDB SQL: proxy raw wide files and the cleaning pipeline."""

from __future__ import annotations

from oracle.proxy_sql import BANDS_CTE, FISCAL, MONTHS, PERIODS_CTE

NUM_RE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
ZERO_WHOLESALE = "('AFRICA', 'AMERICA', 'EUROPE', 'MIDDLE EAST')"
ATTRS = ["code", "description", "brand", "category", "category_prov", "color", "country_of_origin",
         "listing_type", "status", "varietal", "size_ml_per_unit", "units_per_case",
         "wholesale_price_last_year", "wholesale_price_this_year", "retail_price_last_year",
         "retail_price_this_year", "retail_price_current", "price_segment", "promos_list_this_year"]
TITLE_COLS = ["description", "brand", "category", "category_prov", "color", "country_of_origin",
              "listing_type", "status", "varietal"]
REQUIRED = ["description", "brand", "category_prov", "color", "country_of_origin", "varietal"]

_PRICE = "printf('%.2f', p.p_retailprice)"

COMMON = f"""
nr AS (SELECT n.n_nationkey, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey),
op AS (SELECT o.o_orderkey, cr.r_name AS province_code
       FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nr cr ON c.c_nationkey = cr.n_nationkey),
{BANDS_CTE},
cmap AS (
  SELECT color, color_five FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY color ORDER BY ord DESC) AS rn
    FROM (VALUES (1, 'Red', 'Red'), (2, 'White', 'White'), (3, 'Rose', 'Pink'),
                 (4, 'Sparkling', 'Sparkling'), (5, 'White', 'White Still')) t(ord, color, color_five)) x
  WHERE rn = 1),
attrs AS (
  SELECT p.p_partkey,
    CAST(p.p_partkey AS VARCHAR) AS code,
    ['>>', '#-', '*«', '->', ' '][(p.p_partkey % 5) + 1] || p.p_name || ' ,  ' || p.p_type || ' ' AS description,
    upper(p.p_brand) AS brand,
    p.p_type AS category,
    p.p_type || ',' || CAST(CASE WHEN p.p_size <= 10 THEN 375 WHEN p.p_size <= 35 THEN 750
                                 WHEN p.p_size <= 45 THEN 1500 ELSE 3000 END AS VARCHAR) AS category_prov,
    CASE WHEN p.p_size % 17 = 0 THEN NULL
         ELSE ['RED', 'WHITE', 'ROSE', 'SPARKLING', 'AMBER'][(p.p_size % 5) + 1] END AS color,
    CASE WHEN n.n_nationkey = 24 THEN 'usa' ELSE n.n_name END AS country_of_origin,
    CASE WHEN p.p_size > 25 THEN 'special order' ELSE 'general list' END AS listing_type,
    CASE WHEN p.p_partkey % 10 = 0 THEN 'delisted' ELSE 'active' END AS status,
    p.p_type AS varietal,
    CASE WHEN p.p_size <= 10 THEN 375 WHEN p.p_size <= 35 THEN 750
         WHEN p.p_size <= 45 THEN 1500 ELSE 3000 END AS size_ml_per_unit,
    CASE WHEN p.p_size <= 10 THEN 24 WHEN p.p_size <= 35 THEN 12
         WHEN p.p_size <= 45 THEN 6 ELSE 4 END AS units_per_case,
    p.p_retailprice * CAST(0.5 AS DOUBLE) AS wholesale_price_last_year,
    p.p_retailprice * CAST(0.6 AS DOUBLE) AS wholesale_price_this_year,
    CASE p.p_partkey % 7 WHEN 0 THEN {_PRICE} || 'd' WHEN 1 THEN ' ' || {_PRICE} || ' ' ELSE {_PRICE} END
      AS retail_price_last_year,
    {_PRICE} AS retail_price_this_year,
    CASE p.p_partkey % 13 WHEN 0 THEN '$' || {_PRICE} WHEN 1 THEN '1e3' ELSE {_PRICE} END AS retail_price_current,
    'N/A' AS price_segment,
    CASE p.p_partkey % 3 WHEN 0 THEN 'tpr; dsp' WHEN 1 THEN 'TPR' END AS promos_list_this_year
  FROM part p LEFT JOIN nation n ON p.p_partkey % 25 = n.n_nationkey)"""


def _fiscal_label(d: str) -> str:
    fy = f"(CASE WHEN {d} < make_date(year({d}), 4, 1) THEN year({d}) - 1 ELSE year({d}) END)"
    return (f"printf('%04dP%02d', {fy}, CAST(least(13, floor(datediff('day', make_date({fy}, 4, 1), {d}) / 28) + 1)"
            " AS INTEGER))")


def _q(c: str) -> str:
    return f'"{c}"'


def raw_cte(kind: str) -> str:
    """``raw_<kind>``: one wide row per (province, part) with sales in the window."""
    if kind == "M":
        labels, provinces = MONTHS, "('AFRICA', 'AMERICA', 'ASIA')"
        lab = "strftime(l.l_shipdate, '%YM%m')"
        lo, hi = "1999-11-01", "2001-11-01"
    else:
        labels, provinces = FISCAL, "('EUROPE', 'MIDDLE EAST')"
        lab = _fiscal_label("CAST(l.l_shipdate AS DATE)")
        lo, hi = "1999-11-11", "2001-11-11"
    pivots = ",\n    ".join(f"SUM(CASE WHEN label = '{x}' THEN l_quantity END) AS {_q(x)}" for x in labels)
    return f""",
j_{kind} AS (
  SELECT op.province_code, l.l_partkey, {lab} AS label,
         l.l_quantity * CASE l.l_partkey % 11 WHEN 0 THEN 0.0 WHEN 1 THEN -1.0 ELSE 1.0 END AS l_quantity
  FROM lineitem l JOIN op ON l.l_orderkey = op.o_orderkey
  WHERE op.province_code IN {provinces}
    AND l.l_shipdate >= TIMESTAMP '{lo}' AND l.l_shipdate < TIMESTAMP '{hi}'),
w_{kind} AS (
  SELECT province_code, l_partkey,
    {pivots}
  FROM j_{kind} GROUP BY province_code, l_partkey),
raw_{kind} AS (
  SELECT w.province_code, {", ".join("a." + c for c in ATTRS)}, {", ".join("w." + _q(x) for x in labels)}
  FROM w_{kind} w JOIN attrs a ON w.l_partkey = a.p_partkey),
keyed_{kind} AS (SELECT *, province_code || code AS global_code FROM raw_{kind})"""


def _title(c: str) -> str:
    stripped = rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
    titled = (rf"array_to_string(list_transform(regexp_extract_all(lower({stripped}), '\p{{L}}+|\P{{L}}+'), "
              "lambda t: upper(t[1]) || t[2:]), '')")
    return rf"CASE WHEN {c} IS NULL THEN NULL ELSE regexp_replace(replace({titled}, ',', ''), '\s+', ' ', 'g') END"


def clean_cte(kind: str) -> str:
    labels = MONTHS if kind == "M" else FISCAL
    total = " + ".join(f"COALESCE({_q(x)}, 0)" for x in labels)
    titled = ",\n    ".join(f"{_title(c)} AS {c}" for c in TITLE_COLS)
    others = [c for c in ATTRS if c not in TITLE_COLS]
    fix = ("CASE WHEN country_of_origin = 'Usa' THEN 'USA' ELSE country_of_origin END"
           if kind == "P" else "country_of_origin")
    notnull = " AND ".join(f"{c} IS NOT NULL" for c in REQUIRED)
    return f""",
pos_{kind} AS (SELECT *, {total} AS total_sale FROM keyed_{kind}),
pos2_{kind} AS (SELECT * FROM pos_{kind} WHERE total_sale > 0),
title_{kind} AS (
  SELECT province_code, global_code, total_sale, {", ".join(others)}, {", ".join(_q(x) for x in labels)},
    {titled}
  FROM pos2_{kind}),
fix_{kind} AS (SELECT * REPLACE ({fix} AS country_of_origin,
                                 regexp_replace(description, '^>*#*-*\\**«*', '') AS description)
               FROM title_{kind}),
clean_{kind} AS (SELECT * FROM fix_{kind} WHERE {notnull}),
enr_{kind} AS (
  SELECT c.*, m.color_five,
    CASE WHEN regexp_matches(trim(c.retail_price_this_year), '{NUM_RE}')
         THEN TRY_CAST(trim(c.retail_price_this_year) AS DOUBLE) END AS price_num
  FROM clean_{kind} c LEFT JOIN cmap m ON c.color = m.color),
band_{kind} AS (
  SELECT e.* EXCLUDE (wholesale_price_last_year, wholesale_price_this_year),
    CASE WHEN province_code IN {ZERO_WHOLESALE} THEN 0.0 ELSE wholesale_price_last_year END AS wholesale_price_last_year,
    CASE WHEN province_code IN {ZERO_WHOLESALE} THEN 0.0 ELSE wholesale_price_this_year END AS wholesale_price_this_year,
    b.price_segment AS price_segment_retail,
    COALESCE(b.price_segment, (SELECT price_segment FROM bands ORDER BY lo DESC LIMIT 1)) AS price_segment_retail_last
  FROM enr_{kind} e LEFT JOIN bands b ON e.price_num >= b.lo AND e.price_num <= b.hi)"""


def _coerce(c: str, numeric: bool) -> str:
    if numeric:
        return f"round_even(COALESCE(CAST({c} AS DOUBLE), 0) * 100, 0) / 100"
    s = f"trim(CAST({c} AS VARCHAR))"
    return (f"round_even(COALESCE(CASE WHEN regexp_matches({s}, '{NUM_RE}') THEN TRY_CAST({s} AS DOUBLE) END, 0)"
            " * 100, 0) / 100")


PRODUCT_COLS = ["province_code", "description", "brand", "varietal", "color", "color_five", "country_of_origin",
                "category_prov", "category", "listing_type", "size_ml_per_unit", "units_per_case", "status",
                "wholesale_price_last_year", "wholesale_price_this_year", "retail_price_last_year",
                "retail_price_this_year", "retail_price_current", "price_segment", "price_segment_retail"]


def products_sql() -> str:
    sel = ", ".join(["global_code"] + PRODUCT_COLS)
    coerced = [
        f"{_coerce('wholesale_price_last_year', True)} AS wholesale_price_last_year",
        f"{_coerce('wholesale_price_this_year', True)} AS wholesale_price_this_year",
        f"{_coerce('retail_price_last_year', False)} AS retail_price_last_year",
        f"{_coerce('retail_price_this_year', False)} AS retail_price_this_year",
        f"{_coerce('retail_price_current', False)} AS retail_price_current",
    ]
    return f""",
prods AS (SELECT {sel} FROM band_M UNION ALL SELECT {sel} FROM band_P),
prods_c AS (SELECT * REPLACE ({", ".join(coerced)}) FROM prods)"""


def melt_sql(kind: str) -> str:
    labels = MONTHS if kind == "M" else FISCAL
    cols = ", ".join(_q(x) for x in labels)
    return (f"SELECT global_code, sale_period, round_even(sale_actual_cases * 100, 0) / 100 AS sale_actual_cases "
            f"FROM (SELECT global_code, {cols} FROM band_{kind}) "
            f"UNPIVOT INCLUDE NULLS (sale_actual_cases FOR sale_period IN ({cols}))")


def with_etl(body: str, kinds=("M", "P"), clean=True, products=False) -> str:
    """``body`` after the ETL's CTEs; one that begins with a comma goes on with CTEs of its own."""
    ctes = COMMON
    for k in kinds:
        ctes += raw_cte(k)
        if clean:
            ctes += clean_cte(k)
    if products:
        ctes += products_sql()
    return "WITH " + ctes.strip() + "\n" + body


def both(select_m: str, select_p: str | None = None) -> str:
    return f"{select_m}\nUNION ALL\n{select_p or select_m.replace('_M', '_P')}"


SQL: dict[str, str] = {}
SQL["etl_tag_key"] = with_etl(both("SELECT province_code, code, global_code FROM keyed_M"), clean=False)
SQL["etl_positive_total"] = with_etl(both("SELECT global_code, total_sale FROM pos2_M"))
SQL["etl_titlecase"] = with_etl(both(f"SELECT global_code, {', '.join(TITLE_COLS)} FROM clean_M"))
SQL["etl_value_replace"] = with_etl(both("SELECT global_code, province_code, country_of_origin FROM clean_M"))
SQL["etl_lead_strip"] = with_etl(both("SELECT global_code, description FROM clean_M"))
SQL["etl_notnull"] = with_etl(
    "SELECT province_code, COUNT(*) AS rows FROM ("
    + both("SELECT province_code FROM clean_M") + ") t GROUP BY province_code")
SQL["etl_color_lookup"] = with_etl(both("SELECT global_code, color, color_five FROM enr_M"))
SQL["etl_price_band"] = with_etl(both("SELECT global_code, retail_price_this_year, price_segment_retail FROM band_M"))
SQL["etl_price_band_last"] = with_etl(both(
    "SELECT global_code, retail_price_this_year, price_segment_retail_last AS price_segment_retail FROM band_M"))
SQL["etl_union_products"] = with_etl("SELECT * FROM prods_c", products=True)
SQL["etl_numeric_coerce"] = with_etl(
    "SELECT global_code, wholesale_price_last_year, wholesale_price_this_year, retail_price_last_year, "
    "retail_price_this_year, retail_price_current FROM prods_c", products=True)
def raw_melt_sql(kind: str) -> str:
    return melt_sql(kind).replace(f"FROM band_{kind})", f"FROM keyed_{kind})")


SQL["etl_melt"] = with_etl(raw_melt_sql("M") + "\nUNION ALL\n" + raw_melt_sql("P"), clean=False)
SQL["etl_round2"] = with_etl(both(
    "SELECT global_code, round_even(wholesale_price_this_year / 8.0 * 100, 0) / 100 AS rounded FROM keyed_M"), clean=False)
SQL["etl_comma_ws"] = with_etl(both(
    r"""SELECT global_code, regexp_replace(replace(description, ',', ''), '\s+', ' ', 'g') AS description,
       regexp_replace(replace(category_prov, ',', ''), '\s+', ' ', 'g') AS category_prov FROM keyed_M"""), clean=False)
SQL["etl_union_sales"] = with_etl(melt_sql("M") + "\nUNION ALL\n" + melt_sql("P"))
def _null_counts(kind: str) -> str:
    cols = ["province_code", *ATTRS, *(MONTHS if kind == "M" else FISCAL)]
    return ("(SELECT " + ", ".join(f"COUNT(*) - COUNT({_q(c)}) AS {_q(c)}" for c in cols)
            + f" FROM raw_{kind}) UNPIVOT INCLUDE NULLS (null_count FOR column_name IN ("
            + ", ".join(_q(c) for c in cols) + "))")


SQL["dq_null_profile"] = with_etl(
    f"SELECT column_name, sum(null_count) AS null_count FROM (SELECT * FROM {_null_counts('M')} UNION ALL "
    f"SELECT * FROM {_null_counts('P')}) GROUP BY column_name", clean=False)
SQL["dq_step_counts"] = with_etl(
    "SELECT step, sum(rows) AS rows FROM (" + " UNION ALL ".join(f"""
SELECT 'raw' AS step, COUNT(*) AS rows FROM keyed_{k}
UNION ALL SELECT 'positive_total', COUNT(*) FROM pos2_{k}
UNION ALL SELECT 'required_attributes', COUNT(*) FROM clean_{k}
UNION ALL SELECT 'sales_long', COUNT(*) * {n} FROM clean_{k}""" for k, n in (("M", len(MONTHS)), ("P", len(FISCAL))))
    + ") GROUP BY step")
SQL["dq_rejected_rows"] = with_etl(f"""
SELECT 'accepted' AS reason, count(*) AS rows FROM raw_M WHERE least(code::INT % 7, code::INT % 11, code::INT % 13) > 0
UNION ALL SELECT '{MONTHS[0]}: not double', count(*) FROM raw_M WHERE code::INT % 7 = 0 HAVING count(*) > 0
UNION ALL SELECT 'units_per_case: not int', count(*) FROM raw_M WHERE code::INT % 11 = 0 HAVING count(*) > 0
UNION ALL SELECT 'code: empty', count(*) FROM raw_M WHERE code::INT % 13 = 0 HAVING count(*) > 0""", clean=False)
_CODES = """
SELECT global_code, promo_code, COUNT(*) AS occurrences FROM (
  SELECT global_code, upper(trim(unnest(string_split(promos_list_this_year, ';')))) AS promo_code
  FROM (SELECT global_code, promos_list_this_year FROM keyed_M UNION ALL SELECT global_code, promos_list_this_year FROM keyed_P)
  WHERE promos_list_this_year IS NOT NULL) t
WHERE promo_code <> '' GROUP BY global_code, promo_code"""
SQL["fc_promo_codes"] = with_etl(_CODES, clean=False)

SALES_CTE = f""",
sales AS ({melt_sql("M")}
  UNION ALL {melt_sql("P")})"""
SQL["fc_promo_lift_by_type"] = with_etl(SALES_CTE + f""",
codes AS ({_CODES}),
types AS (SELECT DISTINCT promo_code FROM codes),
marked AS (
  SELECT t.promo_code, s.sale_actual_cases AS cases, s.global_code, c.global_code IS NOT NULL AS listed
  FROM sales s CROSS JOIN types t LEFT JOIN codes c ON c.global_code = s.global_code AND c.promo_code = t.promo_code
  WHERE s.sale_actual_cases IS NOT NULL)
SELECT promo_code, count(DISTINCT global_code) FILTER (listed) AS products, avg(cases) FILTER (listed) AS avg_promoted,
       avg(cases) FILTER (NOT listed) AS avg_unpromoted,
       (avg(cases) FILTER (listed) / NULLIF(avg(cases) FILTER (NOT listed), 0) - 1) * 100 AS lift_pct
FROM marked GROUP BY promo_code""")

#: The conformed view from the ETL's own output: standard cases by integers (a ninetieth of
#: the units' hundredths times millilitres is a ten-thousandth of a nine-litre case).
VIEW_CTE = SALES_CTE + f""",
{PERIODS_CTE},
varietals AS (
  SELECT DISTINCT upper(p_type[1]) || lower(p_type[2:]) AS varietal, CAST(p_type NOT IN ('STANDARD', 'PROMO') AS INTEGER) AS in_portfolio
  FROM part),
units AS (
  SELECT p.*, s.sale_period, CAST(round(s.sale_actual_cases * 100) AS HUGEINT) * p.units_per_case AS hundredths,
         CAST(if(relative_year = 'LRY', retail_price_last_year, retail_price_this_year) AS DECIMAL(12,2)) AS price
  FROM sales s JOIN prods_c p USING (global_code) LEFT JOIN periods a ON a.period_code = s.sale_period
  WHERE s.sale_actual_cases IS NOT NULL),
calc_sales AS (
  SELECT province_code, varietal, size_ml_per_unit AS unit_size, brand, global_code AS product_code, description AS product_name,
         price_segment_retail AS price_segment, country_of_origin AS origin, sale_period AS period_code,
         CAST((2 * hundredths * size_ml_per_unit + 90) // 180 AS DECIMAL(30,0)) * CAST(0.0001 AS DECIMAL(5,4)) AS sale_9l_case,
         CAST(hundredths AS DECIMAL(24,0)) * CAST(0.01 AS DECIMAL(3,2)) * price AS revenue
  FROM units)"""

"""Proxy retail market over the TPC-H-like test tables.

The reference's sales warehouse is not public, so every report runs on a market
derived from the provided tables (one canonical mapping, mirrored by the DuckDB
oracle):

===================  =====================================================
province_code        region name of the ordering customer
varietal             ``p_type``
unit_size            ``p_size`` bucketed to 375 / 750 / 1500 / 3000 ml
brand                ``p_brand``
product_code / name  ``p_partkey`` as text / ``p_name``
retail price         ``p_retailprice``; price_segment from closed bands
origin               region name of the supplier
period_code          ``yyyy'M'MM`` of ``l_shipdate``
sale_9l_case         ``l_quantity`` as DECIMAL(18,4)
revenue              ``l_extendedprice * (1 - l_discount)`` in exact decimals
===================  =====================================================

Join strategy: region/nation are fixed-size (5 / 25 rows) and are broadcast
explicitly. customer, orders, part, supplier and lineitem all grow with the scale
factor, so no hint is given for them: Spark broadcasts a side only when its
estimated or (with AQE) measured size is under ``autoBroadcastJoinThreshold`` and
otherwise plans a shuffle join.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.functions.calendar import month_label, python_labels
from shelfscope.operators.conform import period_analogy, with_portfolio
from shelfscope.operators.clean import price_band
from shelfscope.sources.tables import local_table, read_table


# Fixed values of the proxy market.
MONTHLY_ANCHOR = "2001M10"      # last month of the "this rolling year" window
FISCAL_ANCHOR = "2001P08"       # last fiscal period of the same window
UNIT_SIZE_RULE = [(10, 375), (35, 750), (45, 1500)]   # p_size <= bound -> ml; else 3000
UNIT_SIZE_ELSE = 3000
NON_PORTFOLIO_VARIETALS = ["STANDARD", "PROMO"]
PRICE_BAND_FIRST_LABEL = "D"
PRICE_BAND_START = 900.0
PRICE_BAND_WIDTH = 10.0
PRICE_BAND_SPAN = 9.9
PRICE_BAND_COUNT = 9


def price_band_rows() -> list[tuple[str, float, float]]:
    """Closed, disjoint bands [900.0, 909.9], [910.0, 919.9], ... labelled D, E, ..."""
    out = []
    for i in range(PRICE_BAND_COUNT):
        lo = round(PRICE_BAND_START + PRICE_BAND_WIDTH * i, 1)
        out.append((chr(ord(PRICE_BAND_FIRST_LABEL) + i), lo, round(lo + PRICE_BAND_SPAN, 1)))
    return out


def price_bands(spark: SparkSession) -> DataFrame:
    return local_table(spark, price_band_rows(), "price_segment string, price_range_start double, price_range_end double")


def unit_size(p_size) -> F.Column:
    c = F.col(p_size) if isinstance(p_size, str) else p_size
    expr = None
    for bound, ml in UNIT_SIZE_RULE:
        expr = F.when(c <= bound, F.lit(ml)) if expr is None else expr.when(c <= bound, F.lit(ml))
    return expr.otherwise(F.lit(UNIT_SIZE_ELSE))


def region_of_nation(spark: SparkSession, d: str) -> DataFrame:
    """(n_nationkey, r_name): 25 rows by construction, safe to broadcast."""
    nation = read_table(spark, d, "nation", ["n_nationkey", "n_regionkey"])
    region = read_table(spark, d, "region", ["r_regionkey", "r_name"])
    return nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select("n_nationkey", "r_name")


def order_province(spark: SparkSession, d: str) -> DataFrame:
    """(o_orderkey, province_code): region of the ordering customer."""
    nr = F.broadcast(region_of_nation(spark, d))
    cust = read_table(spark, d, "customer", ["c_custkey", "c_nationkey"])
    cust = cust.join(nr, cust.c_nationkey == nr.n_nationkey).select("c_custkey", F.col("r_name").alias("province_code"))
    orders = read_table(spark, d, "orders", ["o_orderkey", "o_custkey"])
    return orders.join(cust, orders.o_custkey == cust.c_custkey).select("o_orderkey", "province_code")


def supplier_origin(spark: SparkSession, d: str) -> DataFrame:
    nr = F.broadcast(region_of_nation(spark, d))
    sup = read_table(spark, d, "supplier", ["s_suppkey", "s_nationkey"])
    return sup.join(nr, sup.s_nationkey == nr.n_nationkey).select("s_suppkey", F.col("r_name").alias("origin"))


def products(spark: SparkSession, d: str, unmatched: str = "null") -> DataFrame:
    """Product dimension: one row per part with its price segment (an expression over the
    bands, which costs nothing where the segment isn't read)."""
    part = read_table(spark, d, "part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"])
    prod = part.select(
        "p_partkey",
        F.col("p_partkey").cast("string").alias("global_code"),
        F.col("p_name").alias("product_name"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("varietal"),
        unit_size("p_size").alias("unit_size"),
        F.col("p_retailprice").alias("retail_price_this_year"),
    )
    return price_band(prod, price_band_rows(), "retail_price_this_year", out="price_segment", unmatched=unmatched)


def varietal_dim(spark: SparkSession, d: str) -> DataFrame:
    """(varietal, in_portfolio). Derived from the part vocabulary; no broadcast hint --
    AQE converts the join once the (tiny) distinct stage has measured its size."""
    part = read_table(spark, d, "part", ["p_type"])
    return part.select(F.col("p_type").alias("varietal")).distinct().withColumn(
        "in_portfolio", F.when(F.col("varietal").isin(*NON_PORTFOLIO_VARIETALS), 0).otherwise(1))


def province_dim(spark: SparkSession, d: str) -> DataFrame:
    region = read_table(spark, d, "region", ["r_name"])
    return region.select(F.col("r_name").alias("province_code"), F.lower("r_name").alias("province_name"))


def report_period_labels() -> list[str]:
    return python_labels("M", MONTHLY_ANCHOR, 24) + python_labels("P", FISCAL_ANCHOR, 26)


def report_periods(spark: SparkSession) -> DataFrame:
    """Period analogy dim for the reports: both calendars, two rolling years each
    (24 monthly + 26 fiscal labels, fixed size)."""
    labels = python_labels("M", MONTHLY_ANCHOR, 24) + python_labels("P", FISCAL_ANCHOR, 26)
    df = local_table(spark, [(x,) for x in labels], "period_code string")
    return period_analogy(df, {"M": MONTHLY_ANCHOR, "P": FISCAL_ANCHOR}, distinct=False)


def window_bounds(anchor: str = MONTHLY_ANCHOR, months: int = 24) -> tuple[_dt.date, _dt.date]:
    """[first day, day after last) of the monthly labels covered by the report dim."""
    labels = python_labels("M", anchor, months)
    y0, m0 = int(labels[0][:4]), int(labels[0][5:])
    y1, m1 = int(labels[-1][:4]), int(labels[-1][5:])
    m1 += 1
    if m1 == 13:
        y1, m1 = y1 + 1, 1
    return _dt.date(y0, m0, 1), _dt.date(y1, m1, 1)


def calc_sales(spark: SparkSession, d: str, window: bool = False, extra_cols: tuple[str, ...] = (),
               portfolio: bool = False) -> DataFrame:
    """Conformed sales view at line grain. ``portfolio=True`` adds ``in_portfolio``, attached
    to the products before the fact join.

    ``window=True`` restricts the fact scan to the two rolling years. Use it only in
    front of an *inner* join to the period dim (where out-of-window rows would be
    dropped anyway); it becomes a parquet ``PushedFilters`` range on ``l_shipdate``.
    """
    li = read_table(spark, d, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity",
                                           "l_extendedprice", "l_discount", "l_shipdate",
                                           *(c for c in extra_cols if c.startswith("l_"))])
    if window:
        lo, hi = window_bounds()
        li = li.filter((F.col("l_shipdate") >= F.lit(lo).cast("timestamp")) & (F.col("l_shipdate") < F.lit(hi).cast("timestamp")))
    op = order_province(spark, d)
    prod = products(spark, d)
    if portfolio:
        prod = with_portfolio(prod, varietal_dim(spark, d))
        extra_cols = (*extra_cols, "in_portfolio")
    so = supplier_origin(spark, d)
    j = (li.join(op, li.l_orderkey == op.o_orderkey)
           .join(prod, li.l_partkey == prod.p_partkey)
           .join(so, li.l_suppkey == so.s_suppkey))
    return j.select(
        "province_code", "varietal", "unit_size", "brand",
        F.col("global_code").alias("product_code"), "product_name", "price_segment", "origin",
        month_label("l_shipdate").alias("period_code"),
        F.col("l_quantity").cast("decimal(18,4)").alias("sale_9l_case"),
        (F.col("l_extendedprice").cast("decimal(12,2)") * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))).alias("revenue"),
        *extra_cols,
    )


def population(spark: SparkSession, d: str) -> DataFrame:
    """(province_code, population): customers per region stand in for population."""
    nr = F.broadcast(region_of_nation(spark, d))
    cust = read_table(spark, d, "customer", ["c_custkey", "c_nationkey"])
    return (cust.join(nr, cust.c_nationkey == nr.n_nationkey)
                .groupBy(F.col("r_name").alias("province_code"))
                .agg(F.count(F.lit(1)).alias("population")))


# ------------------------------------------------------------ raw wide files
# Fixed values of the proxy raw files: which regions report on which calendar, and
# the rules that make the attribute text as untidy as real provincial files.
MONTHLY_PROVINCES = ["AFRICA", "AMERICA", "ASIA"]
FISCAL_PROVINCES = ["EUROPE", "MIDDLE EAST"]
DESCRIPTION_PREFIXES = [">>", "#-", "*«", "->", " "]
RAW_COLORS = ["RED", "WHITE", "ROSE", "SPARKLING", "AMBER"]
COLOR_MAP_ROWS = [(1, "Red", "Red"), (2, "White", "White"), (3, "Rose", "Pink"),
                  (4, "Sparkling", "Sparkling"), (5, "White", "White Still")]
UNITS_PER_CASE = {375: 24, 750: 12, 1500: 6, 3000: 4}


def color_map(spark: SparkSession) -> DataFrame:
    """Colour dimension file (ord = row position; 'White' is listed twice, the later
    entry wins; 'Amber' is missing)."""
    return local_table(spark, COLOR_MAP_ROWS, "ord int, color string, color_five string")


def wide_labels(kind: str) -> list[str]:
    return python_labels(kind, MONTHLY_ANCHOR if kind == "M" else FISCAL_ANCHOR, 24 if kind == "M" else 26)


def _raw_lines(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """(province_code, l_partkey, quantity, period): the fact rows behind one calendar's raw
    files. ``period`` is the label's place among the file's labels. Every eleventh
    product has no quantities and the one after it only returns (negative ones)."""
    from shelfscope.functions.calendar import fiscal_period, label_ordinal, python_label_bounds

    labels = wide_labels(kind)
    provinces = MONTHLY_PROVINCES if kind == "M" else FISCAL_PROVINCES
    lo, hi = python_label_bounds(labels)
    li = read_table(spark, d, "lineitem", ["l_orderkey", "l_partkey", "l_quantity", "l_shipdate"])
    li = li.filter((F.col("l_shipdate") >= F.lit(lo).cast("timestamp")) & (F.col("l_shipdate") < F.lit(hi).cast("timestamp")))
    label = month_label("l_shipdate") if kind == "M" else fiscal_period("l_shipdate")
    first = int(labels[0][:4]) * (12 if kind == "M" else 13) + int(labels[0][5:])
    op = order_province(spark, d).filter(F.col("province_code").isin(*provinces))
    sign = F.when(F.pmod("l_partkey", F.lit(11)) == 0, 0.0).when(F.pmod("l_partkey", F.lit(11)) == 1, -1.0).otherwise(1.0)
    return (li.join(op, li.l_orderkey == op.o_orderkey)
            .select("province_code", "l_partkey", (F.col("l_quantity") * sign).alias("quantity"), label.alias("label"))
            .select("province_code", "l_partkey", "quantity", (label_ordinal("label") - F.lit(first)).alias("period")))


def raw_wide(spark: SparkSession, d: str, kind: str = "M") -> DataFrame:
    """One raw wide 'file' per calendar: (province_code, code, attributes..., one
    quantity column per period label), by one hash aggregation of conditional sums."""
    labels = wide_labels(kind)
    wide = _raw_lines(spark, d, kind).groupBy("province_code", "l_partkey").agg(
        *[F.sum(F.when(F.col("period") == i, F.col("quantity"))).alias(x) for i, x in enumerate(labels)])
    attrs = raw_attributes(spark, d)
    out = wide.join(attrs, wide.l_partkey == attrs.p_partkey)
    return out.select("province_code", *[c for c in attrs.columns if c != "p_partkey"], *labels)


def raw_totals(spark: SparkSession, d: str, kind: str = "M") -> DataFrame:
    """The raw file with the sum over its periods (``total_sale``) in place of the period
    columns: what the product branch of the ETL needs of it."""
    total = _raw_lines(spark, d, kind).groupBy("province_code", "l_partkey").agg(F.sum("quantity").alias("total_sale"))
    attrs = raw_attributes(spark, d)
    out = total.join(attrs, total.l_partkey == attrs.p_partkey)
    return out.select("province_code", *[c for c in attrs.columns if c != "p_partkey"], "total_sale")


def raw_attributes(spark: SparkSession, d: str) -> DataFrame:
    """(p_partkey, the raw files' attributes), one row per part."""
    part = read_table(spark, d, "part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"])
    nation = F.broadcast(read_table(spark, d, "nation", ["n_nationkey", "n_name"]))
    part = part.join(nation, F.pmod(part.p_partkey, F.lit(25)) == nation.n_nationkey, "left")
    size = unit_size("p_size")
    price = F.format_string("%.2f", F.col("p_retailprice"))
    k = F.col("p_partkey")
    upc = F.lit(UNITS_PER_CASE[3000])
    for ml in (1500, 750, 375):
        upc = F.when(size == ml, F.lit(UNITS_PER_CASE[ml])).otherwise(upc)
    return part.select(
        "p_partkey",
        k.cast("string").alias("code"),
        F.concat(F.element_at(F.array(*[F.lit(x) for x in DESCRIPTION_PREFIXES]), (F.pmod(k, F.lit(5)) + 1).cast("int")),
                 F.col("p_name"), F.lit(" ,  "), F.col("p_type"), F.lit(" ")).alias("description"),
        F.upper("p_brand").alias("brand"),
        F.col("p_type").alias("category"),
        F.concat(F.col("p_type"), F.lit(","), size.cast("string")).alias("category_prov"),
        F.when(F.pmod(F.col("p_size"), F.lit(17)) == 0, F.lit(None).cast("string"))
         .otherwise(F.element_at(F.array(*[F.lit(x) for x in RAW_COLORS]),
                                 (F.pmod(F.col("p_size"), F.lit(5)) + 1).cast("int"))).alias("color"),
        F.when(F.col("n_nationkey") == 24, F.lit("usa")).otherwise(F.col("n_name")).alias("country_of_origin"),
        F.when(F.col("p_size") > 25, F.lit("special order")).otherwise(F.lit("general list")).alias("listing_type"),
        F.when(F.pmod(k, F.lit(10)) == 0, F.lit("delisted")).otherwise(F.lit("active")).alias("status"),
        F.col("p_type").alias("varietal"),
        size.alias("size_ml_per_unit"),
        upc.alias("units_per_case"),
        (F.col("p_retailprice") * F.lit(0.5)).alias("wholesale_price_last_year"),  # fixed ratios
        (F.col("p_retailprice") * F.lit(0.6)).alias("wholesale_price_this_year"),
        F.when(F.pmod(k, F.lit(7)) == 0, F.concat(price, F.lit("d")))
         .when(F.pmod(k, F.lit(7)) == 1, F.concat(F.lit(" "), price, F.lit(" ")))
         .otherwise(price).alias("retail_price_last_year"),
        price.alias("retail_price_this_year"),
        F.when(F.pmod(k, F.lit(13)) == 0, F.concat(F.lit("$"), price))
         .when(F.pmod(k, F.lit(13)) == 1, F.lit("1e3"))
         .otherwise(price).alias("retail_price_current"),
        F.lit("N/A").alias("price_segment"),
        F.when(F.pmod(k, F.lit(3)) == 0, F.lit("tpr; dsp")).when(F.pmod(k, F.lit(3)) == 1, F.lit("TPR"))
         .alias("promos_list_this_year"),
    )

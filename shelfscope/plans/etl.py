"""Provincial ETL: wide period files -> cleaned product dimension + long sales fact.

The reference repeats one cleaning block per province; here one function applies
it to a wide DataFrame holding any number of provinces of the same calendar, with
the per-province differences (USA repair, wholesale zeroing) as column conditions.
All steps are narrow (one stage) except the two small broadcast lookups.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.functions.numeric import NUMERIC_TEXT
from shelfscope.operators import clean as C
from shelfscope.operators.reshape import Observed, melt, union_all


@dataclass(frozen=True)
class CalendarSpec:
    """One wide layout: its period columns and which provinces get the USA repair
    and zeroed wholesale prices."""

    period_labels: tuple[str, ...]
    fix_usa: tuple[str, ...] = ()
    zero_wholesale: tuple[str, ...] = ()


def keyed(raw: DataFrame, province_code: str | None = None) -> DataFrame:
    """B1/B2. ``province_code`` tags a single-province file; a multi-province input
    already carries the column."""
    df = C.tag(raw, province_code) if province_code is not None else raw
    return C.global_code(df)


def cleaned_attributes(df: DataFrame, spec: CalendarSpec, observed: Observed | None = None) -> DataFrame:
    """Positive total, required attributes, title case + commas + whitespace,
    USA repair, leading-character strip.

    The reference drops rows with a missing required attribute after the text
    cleaning. An input that has ``total_sale`` instead of the period columns is the
    product branch's. The cleaning maps NULL to NULL and non-NULL to non-NULL, so checking
    first is equivalent -- and it keeps the (pushed-down) NOT NULL filter from
    evaluating every cleaning expression a second time. ``observed`` counts the steps' rows
    while they run (C5).
    """
    seen = observed.watch if observed else lambda step, rows: rows
    df = C.filter_positive(seen("raw", df), [] if "total_sale" in df.columns else list(spec.period_labels))
    df = seen("required_attributes", C.require(seen("positive_total", df)))
    df = C.title_case(df)
    if spec.fix_usa:
        df = C.replace_values(df, "country_of_origin", C.USA_FIX, F.col("province_code").isin(*spec.fix_usa))
    return C.lead_strip(df, "description")


def price_as_number(c) -> F.Column:
    """Numeric view of a price column for the band lookup: invalid text -> NULL."""
    s = F.trim(F.col(c).cast("string"))
    return F.when(s.rlike(NUMERIC_TEXT), s.try_cast("double"))


def enriched(df: DataFrame, colors: DataFrame, bands: list[tuple[str, float, float]], spec: CalendarSpec,
             unmatched: str = "null") -> DataFrame:
    """Drop helpers, colour lookup, price band of this year's retail price,
    zero wholesale prices where the province has none."""
    df = df.drop("code", "total_sale")
    df = C.lookup(df, colors, "color", "color_five", order_col="ord")
    df = df.withColumn("__price", price_as_number("retail_price_this_year"))
    df = C.price_band(df, bands, "__price", out="price_segment_retail", unmatched=unmatched).drop("__price")
    if spec.zero_wholesale:
        df = C.set_constant(df, ["wholesale_price_last_year", "wholesale_price_this_year"],
                            where=F.col("province_code").isin(*spec.zero_wholesale))
    return df


def products_of(df: DataFrame) -> DataFrame:
    """B15."""
    return df.select("global_code", *C.PRODUCT_ATTRIBUTES)


def sales_of(df: DataFrame, spec: CalendarSpec, ids: tuple[str, ...] = ("global_code",)) -> DataFrame:
    """B16 + C1 + B18: key + period columns, unpivoted, NumPy-rounded."""
    return melt(df.select(*ids, *spec.period_labels), list(ids), list(spec.period_labels))


def clean(raw: DataFrame, colors: DataFrame, bands: list[tuple[str, float, float]], spec: CalendarSpec,
          unmatched: str = "null", observed: Observed | None = None) -> tuple[DataFrame, DataFrame]:
    """Full per-calendar block: returns (products, long sales)."""
    e = enriched(cleaned_attributes(keyed(raw), spec, observed), colors, bands, spec, unmatched)
    return products_of(e), sales_of(e, spec)


def conform_products(*products: DataFrame) -> DataFrame:
    """C2 + B17: union the provinces' products and coerce the price columns."""
    return C.coerce_prices(union_all(*products))


def conform_sales(*sales: DataFrame) -> DataFrame:
    """C3."""
    return union_all(*sales)


def promo_codes(products_raw: DataFrame, col: str = "promos_list_this_year", sep: str = ";") -> DataFrame:
    """K0: one row per (global_code, promo_code) from the delimited promo list, with
    the number of listed occurrences."""
    codes = F.explode(F.split(F.col(col), sep)).alias("promo_code")
    return (products_raw.select("global_code", codes)
            .withColumn("promo_code", F.upper(F.trim("promo_code")))
            .filter(F.col("promo_code") != "")
            .groupBy("global_code", "promo_code").agg(F.count(F.lit(1)).alias("occurrences")))


#: Litres of a standard case are nine; package sizes are in millilitres.
STANDARD_CASE_ML = 9000


def sales_view(sales: DataFrame, products: DataFrame, periods: DataFrame | None = None, this_year: str = "TRY",
               last_year: str = "LRY") -> DataFrame:
    """the conformed sales view from the ETL's long sales and products.

    ``sale_9l_case = cases * units_per_case * size_ml / 9000`` and
    ``revenue = cases * units_per_case * retail price``, in exact decimals. With the period
    dim, revenue takes last year's price in its last-year periods and this year's
    otherwise; without it, this year's price throughout. Both sides grow, so the join
    has no hint.
    """
    p = products.select(
        "global_code", "province_code", "varietal", F.col("size_ml_per_unit").alias("unit_size"), "brand",
        F.col("description").alias("product_name"), F.col("price_segment_retail").alias("price_segment"),
        F.col("country_of_origin").alias("origin"), "units_per_case",
        F.col("retail_price_this_year").cast("decimal(12,2)").alias("__ty"),
        F.col("retail_price_last_year").cast("decimal(12,2)").alias("__ly"))
    s = sales.where(F.col("sale_actual_cases").isNotNull()).select(
        F.col("global_code").alias("product_code"), F.col("sale_period").alias("period_code"),
        F.col("sale_actual_cases").cast("decimal(18,2)").alias("__cases"))
    j = s.join(p, s.product_code == p.global_code)
    price = F.col("__ty")
    if periods is not None:
        year = periods.select(F.col("period_code").alias("__period"), "relative_year")
        j = j.join(year, j.period_code == year["__period"], "left")
        price = F.when(F.col("relative_year") == last_year, F.col("__ly")).otherwise(price)
    units = (F.col("__cases") * F.col("units_per_case")).cast("decimal(18,2)")
    return j.select(
        "province_code", "varietal", "unit_size", "brand", "product_code", "product_name", "price_segment", "origin",
        "period_code", (units * F.col("unit_size") / F.lit(STANDARD_CASE_ML)).cast("decimal(18,4)").alias("sale_9l_case"),
        (units * price).cast("decimal(28,4)").alias("revenue"))

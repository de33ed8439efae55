"""Row cleaning and derivation over wide provincial tables (one narrow stage)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.functions import numeric as N
from shelfscope.functions import text as X

# Fixed values of the reference cleaning rules.
TITLECASE_COLUMNS = ["description", "brand", "category", "category_prov", "color",
                     "country_of_origin", "listing_type", "status", "varietal"]
NOTNULL_COLUMNS = ["description", "brand", "category_prov", "color", "country_of_origin", "varietal"]
PRODUCT_ATTRIBUTES = ["province_code", "description", "brand", "varietal", "color", "color_five",
                      "country_of_origin", "category_prov", "category", "listing_type",
                      "size_ml_per_unit", "units_per_case", "status",
                      "wholesale_price_last_year", "wholesale_price_this_year",
                      "retail_price_last_year", "retail_price_this_year", "retail_price_current",
                      "price_segment", "price_segment_retail"]
PRICE_COLUMNS = ["wholesale_price_last_year", "wholesale_price_this_year",
                 "retail_price_last_year", "retail_price_this_year", "retail_price_current"]
USA_FIX = {"Usa": "USA"}


def tag(df: DataFrame, province_code: str) -> DataFrame:
    """B1: constant province code."""
    return df.withColumn("province_code", F.lit(province_code))


def global_code(df: DataFrame, code_col: str = "code") -> DataFrame:
    """B2: surrogate key ``province_code || code``; ``code`` is text, NULL stays NULL."""
    return df.withColumn("global_code", F.concat(F.col("province_code"), F.col(code_col).cast("string")))


def filter_positive(df: DataFrame, period_cols: list[str], total_col: str = "total_sale") -> DataFrame:
    """B3+B4: row total over the period columns (NULL counts 0), keep total > 0."""
    if period_cols:  # else the input has the total itself
        df = df.withColumn(total_col, N.row_total(period_cols))
    return df.filter(F.col(total_col) > 0)


def title_case(df: DataFrame, cols: list[str] = TITLECASE_COLUMNS) -> DataFrame:
    """Strip, title-case, remove commas, squeeze whitespace."""
    return df.withColumns({c: X.clean_attribute(c) for c in cols})


def replace_values(df: DataFrame, col: str, mapping: dict[str, str], where: Column | None = None) -> DataFrame:
    """Exact whole-value replacement, only in the rows of ``where`` if given."""
    expr = F.col(col)
    for old, new in mapping.items():
        hit = F.col(col) == F.lit(old)
        expr = F.when(hit if where is None else hit & where, F.lit(new)).otherwise(expr)
    return df.withColumn(col, expr)


def lead_strip(df: DataFrame, col: str = "description", chars=tuple(X.LEAD_CHARS)) -> DataFrame:
    """Ordered strip of leading characters."""
    return df.withColumn(col, X.lead_strip(col, chars))


def require(df: DataFrame, cols: list[str] = NOTNULL_COLUMNS) -> DataFrame:
    """Drop rows NULL in any required attribute."""
    return df.na.drop(how="any", subset=cols)


def lookup(df: DataFrame, dim: DataFrame, key: str, value: str, order_col: str, out: str | None = None) -> DataFrame:
    """Dictionary lookup (left join). A duplicated dim key keeps its *last* entry by
    ``order_col`` (the row's place in the file, see ``sources.tables.read_dim``), like a
    Python dict built from the rows in order. The planner broadcasts the mapping where
    its size allows."""
    out = out or value
    d = dim.groupBy(F.col(key).alias("__k")).agg(F.max_by(value, order_col).alias("__v"))
    return df.join(d, df[key] == d["__k"], "left").drop("__k").withColumnRenamed("__v", out)


#: Bands are an expression over the row; a file with more is refused.
MAX_BANDS = 1000


def band_rows(bands: DataFrame) -> list[tuple[str, float, float]]:
    """The rows of a price-band file, checked; at most ``MAX_BANDS`` come to the driver."""
    got = bands.select("price_segment", "price_range_start", "price_range_end").limit(MAX_BANDS + 1).collect()
    if len(got) > MAX_BANDS:
        raise ValueError(f"more than {MAX_BANDS} price bands")
    rows = [tuple(r) for r in got]
    validate_bands(rows)
    return rows


def price_band(df: DataFrame, bands: list[tuple[str, float, float]], price_col: str, out: str = "price_segment_retail",
               unmatched: str = "null") -> DataFrame:
    """Closed-interval lookup of a price into disjoint bands (rows of label, start
    and end; overlaps are refused).

    ``unmatched='null'`` leaves NULL for gaps, NULL and out-of-range prices;
    ``unmatched='last'`` reproduces the reference's silent fallback to the last band
    (greatest start). The lookup is a column expression: no join, and nothing to do
    where the segment isn't read.
    """
    validate_bands(bands)
    rows = sorted(bands, key=lambda r: r[1])
    price, seg = F.col(price_col), F.lit(None).cast("string")
    for label, lo, hi in reversed(rows):
        seg = F.when((price >= F.lit(lo)) & (price <= F.lit(hi)), F.lit(label)).otherwise(seg)
    if unmatched == "last" and rows:
        seg = F.coalesce(seg, F.lit(rows[-1][0]))
    return df.withColumn(out, seg)


def validate_bands(rows: list[tuple[str, float, float]]) -> None:
    """Closed bands must not overlap (the reference's interval index rejects it)."""
    srt = sorted(rows, key=lambda r: r[1])
    for (a, lo_a, hi_a), (b, lo_b, hi_b) in zip(srt, srt[1:]):
        if lo_b <= hi_a:
            raise ValueError(f"price bands {a} [{lo_a}, {hi_a}] and {b} [{lo_b}, {hi_b}] overlap")


def set_constant(df: DataFrame, cols: list[str], value=0.0, where: Column | None = None) -> DataFrame:
    """A constant in ``cols``, only in the rows of ``where`` if given."""
    if where is None:
        return df.withColumns({c: F.lit(value) for c in cols})
    return df.withColumns({c: F.when(where, F.lit(value)).otherwise(F.col(c).cast("double")) for c in cols})


def coerce_prices(df: DataFrame, cols: list[str] = PRICE_COLUMNS) -> DataFrame:
    """Invalid text -> 0, round 2 (NumPy style). Columns that are already
    numeric skip the text check."""
    from pyspark.sql.types import NumericType

    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({
        c: (N.round2(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) if isinstance(types[c], NumericType)
            else N.coerce_numeric(c))
        for c in cols})

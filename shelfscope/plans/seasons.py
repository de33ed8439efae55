"""Seasons compared across provinces that report on different calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.functions.calendar import FISCAL_PERIODS, MONTHS, label_ordinal, label_seq
from shelfscope.functions.numeric import ratio, ratio0, yoy
from shelfscope.operators.measures import rolling_year, total_over
from shelfscope.operators.overlap import spread

MARKET = ("province_code", "varietal")


def season_sales(sales: DataFrame, kind: str = "P") -> DataFrame:
    """Volume and volume a covered day of each market in each season of the calendar ``kind``.

    A province's season is covered on the days for which it delivered a period, so a season at
    the edge of what was delivered, or of another calendar, is compared by its daily rate.
    The days come with the spread rows, so the sales are read once; a window partition is a
    province's season: a row a varietal, each with the three periods at most it came from."""
    parts = spread(sales, kind, ("sale_9l_case",), MARKET)
    markets = parts.groupBy(*MARKET, "season_code").agg(
        F.sum("sale_9l_case").alias("sale_9l_case"), F.collect_set(F.struct("period_code", "days")).alias("__seen"))
    seen = F.flatten(F.collect_set("__seen").over(Window.partitionBy("province_code", "season_code")))
    days = F.aggregate(F.array_distinct(seen), F.lit(0), lambda n, x: n + x["days"])
    return (markets.select(*MARKET, "season_code", "sale_9l_case", days.alias("covered_days"))
            .withColumn("daily_rate", ratio("sale_9l_case", "covered_days")))


def season_comparison(sales: DataFrame, anchor: str, kind: str = "P") -> DataFrame:
    """One row for each market and season number: the daily rates of the last and this rolling
    year that end with the label ``anchor``, their change, the season's index against the
    market's whole year (100: as much a day as on average), and how far that index is from the
    mean index of the varietal over all provinces.

    Rates are sums over covered days, so provinces of both calendars stand side by side."""
    s = season_sales(sales, kind)
    back = label_ordinal(F.lit(anchor)) - label_ordinal("season_code")
    per_year = FISCAL_PERIODS if kind == "P" else MONTHS
    s = s.select("*", F.when(back.between(0, per_year - 1), "TRY").when(back.between(per_year, 2 * per_year - 1), "LRY")
                 .alias("relative_year"), label_seq("season_code").alias("season")).where("relative_year IS NOT NULL")
    by = rolling_year(s, [*MARKET, "season"], {
        "vol_ly": ("sale_9l_case", "LRY"), "days_ly": ("covered_days", "LRY"),
        "vol_ty": ("sale_9l_case", "TRY"), "days_ty": ("covered_days", "TRY")})
    rate = by.select(*MARKET, "season", "vol_ty", "days_ty", ratio("vol_ly", "days_ly").alias("rate_ly"),
                     ratio("vol_ty", "days_ty").alias("rate_ty"))
    average = ratio(total_over("vol_ty", list(MARKET)), total_over("days_ty", list(MARKET)))
    indexed = rate.select(*MARKET, "season", "rate_ly", "rate_ty", yoy("rate_ty", "rate_ly").alias("rate_change_pct"),
                          ratio0("rate_ty", average, 100.0).alias("season_index"))
    mean = F.avg("season_index").over(Window.partitionBy("varietal", "season"))  # a row a province
    return indexed.withColumn("index_gap", F.col("season_index") - mean)

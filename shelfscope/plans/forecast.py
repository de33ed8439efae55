"""Organic (promotion de-biased) demand forecast as distributed aggregates.

Model, per series s (e.g. one varietal):  y_t = a_{s,season(t)} + b_s * promo_t + e_t,
i.e. OLS with one dummy per season and a promotion regressor. By the
Frisch-Waugh-Lovell theorem the promotion slope equals the no-intercept slope of
season-demeaned y on season-demeaned promo:

    b_s = sum(x~ * y~) / sum(x~^2),   x~ = promo - mean_season(promo),  y~ = y - mean_season(y)

and the seasonal intercepts are a = mean_season(y) - b * mean_season(promo). The
organic forecast sets promo = 0, so it is ``a`` of the target month's season. All of
this is window averages plus grouped sums -- no Python UDF and no per-series model
object, so it scales with the number of series. The functional form (level, no
trend) is a reconstruction; the reference describes the model but does not ship it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.functions.calendar import FISCAL_PERIODS, MONTHS, fiscal_period, label_seq, month_label

# 90% two-sided normal quantile, horizon of thirteen periods.
Z90 = 1.6448536269514722
HORIZON = 13

#: Periods a year of each calendar.
PER_YEAR = {"month": MONTHS, "fiscal": FISCAL_PERIODS}


def series_points(sales: DataFrame, series: str, period: str, y: str, promo_score: str,
                  promo_threshold_pct: int = 5, calendar: str = "month") -> DataFrame:
    """(series, period_no, season, year, y, promo): one point per series and period of the
    calendar, where ``period_no`` counts periods (year * periods a year + season - 1).

    promo = 1 when the period's average promotion score (a fraction, e.g. a discount)
    reaches ``promo_threshold_pct`` percent; the test runs on whole percent points
    summed as integers, so the decision is exact."""
    pts = F.round(F.col(promo_score) * F.lit(100.0)).cast("long")
    label = month_label(period) if calendar == "month" else fiscal_period(period)
    g = sales.groupBy(F.col(series).alias("series"), label.alias("__label")).agg(
        F.sum(y).cast("double").alias("y"), F.sum(pts).alias("__pts"), F.count(F.lit(1)).alias("__n"))
    promo = F.when(F.col("__pts") >= F.col("__n") * F.lit(promo_threshold_pct), 1.0).otherwise(0.0)
    year, season = F.substring("__label", 1, 4).cast("int"), label_seq("__label")
    return g.select("series", (year * F.lit(PER_YEAR[calendar]) + season - F.lit(1)).alias("period_no"),
                    season.alias("season"), year.alias("year"), "y", promo.alias("promo"))


def period_text(no: Column, calendar: str = "month") -> Column:
    """``yyyy-MM`` or ``yyyyPpp`` of a period number."""
    n = F.lit(PER_YEAR[calendar])
    return F.format_string("%04d-%02d" if calendar == "month" else "%04dP%02d", F.floor(no / n).cast("int"),
                           (F.pmod(no, n) + 1).cast("int"))


def promo_lift(points: DataFrame) -> DataFrame:
    """K1: average promoted vs unpromoted volume per series and the lift in %."""
    g = points.groupBy("series").agg(
        F.avg(F.when(F.col("promo") == 1.0, F.col("y"))).alias("avg_promoted"),
        F.avg(F.when(F.col("promo") == 0.0, F.col("y"))).alias("avg_unpromoted"),
        F.count(F.when(F.col("promo") == 1.0, 1)).alias("promoted_periods"))
    lift = (F.col("avg_promoted") / F.nullif(F.col("avg_unpromoted"), F.lit(0.0)) - F.lit(1.0)) * F.lit(100.0)
    return g.withColumn("lift_pct", lift)


def promo_lift_by_type(sales: DataFrame, codes: DataFrame) -> DataFrame:
    """K1 over K0: per promotion type, the average cases of a product period with the type
    listed, of one without it, and the lift in %.

    ``sales`` is the long sales fact, ``codes`` (global_code, promo_code) with each pair once.
    Products are summed first; what a type lacks is the whole less what it has, so the
    fact is read once and no product is paired with the types that it doesn't list.
    """
    per = (sales.where(F.col("sale_actual_cases").isNotNull()).groupBy("global_code")
           .agg(F.sum("sale_actual_cases").alias("cases"), F.count("sale_actual_cases").alias("periods")))
    listed = (per.join(codes.select("global_code", "promo_code"), "global_code", "left")
              # a product of several types counts once in the whole
              .withColumn("__first", F.row_number().over(Window.partitionBy("global_code").orderBy("promo_code")) == 1))
    by = listed.groupBy("promo_code").agg(
        F.sum("cases").alias("cases"), F.sum("periods").alias("periods"), F.count(F.lit(1)).alias("products"),
        F.sum(F.when(F.col("__first"), F.col("cases"))).alias("__cases"),
        F.sum(F.when(F.col("__first"), F.col("periods"))).alias("__periods"))
    whole = Window.partitionBy(F.lit(1))  # a row a type
    r = by.select("*", F.sum("__cases").over(whole).alias("all_cases"), F.sum("__periods").over(whole).alias("all_periods"))
    avg_with = F.col("cases") / F.nullif(F.col("periods").cast("double"), F.lit(0.0))
    avg_without = ((F.col("all_cases") - F.col("cases"))
                   / F.nullif((F.col("all_periods") - F.col("periods")).cast("double"), F.lit(0.0)))
    return (r.where(F.col("promo_code").isNotNull())
            .select("promo_code", "products", avg_with.alias("avg_promoted"), avg_without.alias("avg_unpromoted"))
            .withColumn("lift_pct", (F.col("avg_promoted") / F.nullif(F.col("avg_unpromoted"), F.lit(0.0)) - 1.0) * 100.0))


def _demeaned(points: DataFrame) -> DataFrame:
    w = Window.partitionBy("series", "season")
    return points.select("*", F.avg("y").over(w).alias("y_season_mean"), F.avg("promo").over(w).alias("promo_season_mean"),
                         F.count(F.lit(1)).over(w).alias("season_n")) \
                 .withColumn("y_dm", F.col("y") - F.col("y_season_mean")) \
                 .withColumn("x_dm", F.col("promo") - F.col("promo_season_mean"))


def ols_fit(points: DataFrame) -> DataFrame:
    """K2: per-series promotion slope, observation count, seasons and residual SE."""
    d = _demeaned(points)
    g = d.groupBy("series").agg(
        F.sum(F.col("x_dm") * F.col("y_dm")).alias("sxy"), F.sum(F.col("x_dm") * F.col("x_dm")).alias("sxx"),
        F.sum(F.col("y_dm") * F.col("y_dm")).alias("syy"), F.count(F.lit(1)).alias("n"),
        F.countDistinct("season").alias("seasons"))
    beta = F.coalesce(F.col("sxy") / F.nullif(F.col("sxx"), F.lit(0.0)), F.lit(0.0))
    g = g.withColumn("promo_slope", beta)
    # residual sum of squares of the demeaned regression = syy - b * sxy
    sse = F.greatest(F.col("syy") - F.col("promo_slope") * F.col("sxy"), F.lit(0.0))
    dof = F.col("n") - F.col("seasons") - F.lit(1)
    return g.select("series", "n", "seasons", "promo_slope",
                    F.sqrt(sse / F.nullif(dof.cast("double"), F.lit(0.0))).alias("resid_se"))


def fitted(points: DataFrame, fit: DataFrame) -> DataFrame:
    d = _demeaned(points).join(fit.select("series", "promo_slope"), "series")
    return d.withColumn("y_hat", F.col("y_season_mean") + F.col("promo_slope") * F.col("x_dm")) \
            .withColumn("resid", F.col("y") - F.col("y_hat"))


def organic_forecast(points: DataFrame, fit: DataFrame | None = None, horizon: int = HORIZON,
                     z: float = Z90, calendar: str = "month") -> DataFrame:
    """K3/K4: organic forecast (promo = 0) for each of the ``horizon`` periods after each
    series' last observed one, with High / Low bands at +-z residual SE.

    ``fit`` (per series: ``promo_slope``, ``resid_se``) is used where given; else the model is
    fitted on ``points``. A step whose season was never observed for the series is there
    with NULL values: there is nothing to forecast it from; so is every step of a series that
    a given ``fit`` has no row for. Without residual degrees of freedom the band has no width.
    """
    fit = ols_fit(points) if fit is None else fit
    seasons = points.groupBy("series", "season").agg(
        F.avg("y").alias("y"), F.avg("promo").alias("promo"), F.max("period_no").alias("last"))
    # one row a series: its last period and, for each of at most 13 seasons, the two means
    means = F.map_from_entries(F.collect_list(F.struct("season", F.struct("y", "promo").alias("m"))))
    s = (seasons.groupBy("series").agg(F.max("last").alias("last"), means.alias("means"))
         .join(fit.select("series", "promo_slope", "resid_se"), "series", "left")
         .select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
         .withColumn("no", F.col("last") + F.col("step"))
         .withColumn("season", (F.pmod("no", F.lit(PER_YEAR[calendar])) + 1).cast("int")))
    m = F.try_element_at("means", F.col("season"))
    median = m["y"] - F.col("promo_slope") * m["promo"]
    band = F.lit(z) * F.coalesce(F.col("resid_se"), F.lit(0.0))
    return s.select("series", "step", period_text(F.col("no"), calendar).alias("target_period"), "season",
                    median.alias("forecast_median"), (median + band).alias("forecast_high"),
                    (median - band).alias("forecast_low"))


def accuracy(points: DataFrame, fit: DataFrame) -> DataFrame:
    """K5: in-sample R^2 and MAPE (over points with y > 0) per series."""
    f = fitted(points, fit)
    w = Window.partitionBy("series")
    f = f.withColumn("y_mean", F.avg("y").over(w))
    g = f.groupBy("series").agg(
        F.sum(F.col("resid") * F.col("resid")).alias("sse"),
        F.sum((F.col("y") - F.col("y_mean")) * (F.col("y") - F.col("y_mean"))).alias("sst"),
        F.avg(F.when(F.col("y") > 0, F.abs(F.col("resid")) / F.col("y"))).alias("mape_frac"))
    return g.select("series", (F.lit(1.0) - F.col("sse") / F.nullif(F.col("sst"), F.lit(0.0))).alias("r2"),
                    (F.col("mape_frac") * F.lit(100.0)).alias("mape_pct"))


def decompose(points: DataFrame, fit: DataFrame) -> DataFrame:
    """K6: per series and year, actual volume split into promotion effect and baseline."""
    d = points.join(fit.select("series", "promo_slope"), "series")
    g = d.groupBy("series", "year").agg(F.sum("y").alias("actual"),
                                        F.sum(F.col("promo_slope") * F.col("promo")).alias("promo_effect"))
    return g.withColumn("baseline", F.col("actual") - F.col("promo_effect"))

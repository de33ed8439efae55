"""Accuracy outside the sample, and the lift of single promoted periods.

**Rolling origin.** Every observed period of a series is an origin: the model of ``forecast``
(season means and a promotion slope) is fitted on the points up to it and predicts the
periods after it from their season and promotion flag. Refitting is not needed: a season's
sums up to a point are prefix sums, and a new point changes only its own season's centred
products, so the slope at an origin is a running sum of those changes. One shuffle by
series serves all of it; a series' points are bounded by the calendar.

**Activations.** Each promoted period is held against what its series sold without promotion
around it: the nearest unpromoted period on either side, interpolated by distance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.plans.forecast import PER_YEAR, period_text


def as_of(points: DataFrame) -> DataFrame:
    """Each point with the model of all points up to and including it (``slope``, ``n``,
    ``seasons``), and its season's means before it (``y_mean``, ``x_mean``; NULL where it is
    the season's first). Points of a series have distinct ``period_no``."""
    one = points.select("series", "period_no", "season", "y", F.col("promo").alias("x")).repartition("series")
    season = Window.partitionBy("series", "season").orderBy("period_no")
    upto = season.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = season.rowsBetween(Window.unboundedPreceding, -1)

    def centred(a: str, b: str, w) -> F.Column:
        n = F.count(F.lit(1)).over(w)
        return F.sum(F.col(a) * F.col(b)).over(w) - F.sum(a).over(w) * F.sum(b).over(w) / F.nullif(n, F.lit(0))

    def gain(a: str, b: str) -> F.Column:
        return centred(a, b, upto) - F.coalesce(centred(a, b, before), F.lit(0.0))

    one = one.select("*", F.avg("y").over(before).alias("y_mean"), F.avg("x").over(before).alias("x_mean"),
                     gain("x", "y").alias("__xy"), gain("x", "x").alias("__xx"))
    whole = Window.partitionBy("series").orderBy("period_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a sum of squares that is rounding and nothing else is no variation
    xx = F.sum("__xx").over(whole)
    return one.select(
        "series", "period_no", "season", "y", "x", "y_mean", "x_mean",
        F.when(xx > 1e-9, F.sum("__xy").over(whole) / xx).otherwise(0.0).alias("slope"),
        F.count(F.lit(1)).over(whole).alias("n"),
        F.sum(F.when(F.col("y_mean").isNull(), 1).otherwise(0)).over(whole).alias("seasons"))


def predictions(points: DataFrame, horizon: int | None = None, min_years: int = 2, calendar: str = "month") -> DataFrame:
    """(series, origin, period_no, step, y, y_hat): each origin's forecasts of the observed
    periods up to ``horizon`` (a year, at most) after it. Origins have at least
    ``min_years`` years of points and a residual degree of freedom; a period whose
    season wasn't seen up to the origin has no forecast."""
    year = PER_YEAR[calendar]
    horizon = year if horizon is None else horizon
    if not 0 < horizon <= year:
        raise ValueError(f"the horizon must be 1 to {year} periods")  # further on, the origin's season means would be others
    near = Window.partitionBy("series").orderBy("period_no").rangeBetween(-horizon, -1)
    origins = F.collect_list(F.struct(F.col("period_no").alias("origin"), "slope", "n", "seasons")).over(near)  # a year of them at most
    p = as_of(points).select("*", origins.alias("__o")).where("y_mean IS NOT NULL").select("*", F.explode("__o").alias("o"))
    enough = (F.col("o.n") >= min_years * year) & (F.col("o.n") - F.col("o.seasons") - 1 > 0)
    return p.where(enough).select(
        "series", F.col("o.origin").alias("origin"), "period_no", (F.col("period_no") - F.col("o.origin")).alias("step"), "y",
        (F.col("y_mean") + F.col("o.slope") * (F.col("x") - F.col("x_mean"))).alias("y_hat"))


def _measures() -> list:
    e = F.col("y") - F.col("y_hat")
    sse, n = F.sum(e * e), F.count(F.lit(1))
    sst = F.sum(F.col("y") * F.col("y")) - F.sum("y") * F.sum("y") / n
    return [n.alias("targets"), (F.avg(F.when(F.col("y") > 0, F.abs(e) / F.col("y"))) * 100.0).alias("mape_pct"),
            F.when((n > 1) & (sst > 0), F.lit(1.0) - sse / sst).alias("r2")]


def backtest(points: DataFrame, horizon: int | None = None, min_years: int = 2, calendar: str = "month") -> DataFrame:
    """K5 out of sample, per series and origin: targets, MAPE and R^2 (against the targets' own
    mean; NULL for a single target)."""
    by = predictions(points, horizon, min_years, calendar).groupBy("series", "origin").agg(*_measures())
    return by.select("series", period_text(F.col("origin"), calendar).alias("origin"), "targets", "mape_pct", "r2")


def backtest_steps(points: DataFrame, horizon: int | None = None, min_years: int = 2, calendar: str = "month") -> DataFrame:
    """K5 out of sample, per series and step ahead, over all origins."""
    return predictions(points, horizon, min_years, calendar).groupBy("series", "step").agg(*_measures())


def activations(points: DataFrame, calendar: str = "month") -> DataFrame:
    """K1 per activated period: one row for each promoted point with the nearest unpromoted
    points of its series before and after it (``gap_before``, ``gap_after`` in periods), the
    baseline between them at the point's place, and the lift over it in %. With one side only
    that side is the baseline; without either, or with a baseline of 0, the lift is NULL."""
    plain = F.when(F.col("promo") == 0.0, F.struct("period_no", "y"))
    w = Window.partitionBy("series").orderBy("period_no")
    before = F.last(plain, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(plain, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    p = points.select("series", "period_no", "y", "promo", before.alias("b"), after.alias("a")).where("promo = 1.0")
    gone, ahead = F.col("period_no") - F.col("b.period_no"), F.col("a.period_no") - F.col("period_no")
    between = (F.col("b.y") * ahead + F.col("a.y") * gone) / (gone + ahead)
    p = p.select("series", period_text(F.col("period_no"), calendar).alias("period"), F.col("y").alias("actual"),
                 F.coalesce(between, F.col("b.y"), F.col("a.y")).alias("baseline"), gone.alias("gap_before"), ahead.alias("gap_after"))
    return p.withColumn("lift_pct", (F.col("actual") / F.nullif("baseline", F.lit(0.0)) - 1.0) * 100.0)


def activation_lift(points: DataFrame, calendar: str = "month") -> DataFrame:
    """K1 over its activations, per series: their number, the mean of their lifts, and the lift
    of their summed volume over their summed baselines."""
    g = activations(points, calendar).groupBy("series").agg(
        F.count(F.lit(1)).alias("activations"), F.avg("lift_pct").alias("mean_lift_pct"),
        F.sum(F.when(F.col("baseline").isNotNull(), F.col("actual"))).alias("__y"), F.sum("baseline").alias("__b"))
    return g.select("series", "activations", "mean_lift_pct",
                    ((F.col("__y") / F.nullif("__b", F.lit(0.0)) - 1.0) * 100.0).alias("pooled_lift_pct"))

"""Seasonal least squares with several regressors, per series, as grouped sums.

Model, per series s:  y_t = a_{s,season(t)} + sum_i b_{s,i} x_{i,t} + e_t.  Taking the season
means out of y and of every x leaves a regression without dummies (Frisch-Waugh-Lovell),
whose normal equations need only the sums of products within seasons. So a series' points
are reduced to one row (p regressors: (p+1)(p+2)/2 sums a season, partially aggregated in each
task), and the p x p system is solved in that row by a Cholesky factorisation written as
column expressions. Nothing is fitted on the driver and there is no Python code in a task.

A regressor that the ones before it explain (its pivot is under ``TOLERANCE`` of its own
sum of squares), or that doesn't vary within a season, gets the coefficient 0 and no
standard error; it costs no degree of freedom.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.functions.calendar import fiscal_period, label_seq, month_label
from shelfscope.functions.quantiles import t_column
from shelfscope.plans.forecast import HORIZON, PER_YEAR, Z90, period_text

TOLERANCE = 1e-9


def promo_flags(codes: DataFrame, types: dict[str, str], key: str = "global_code") -> DataFrame:
    """One row a product: for each column name of ``types``, 1.0 where its promotion code is
    listed in ``codes`` (``key``, promo_code), else 0.0. Products without any code have no row."""
    return codes.groupBy(key).agg(*[F.max(F.when(F.col("promo_code") == code, 1.0).otherwise(0.0)).alias(c) for c, code in types.items()])


def regressor_points(lines: DataFrame, series: str, period: str, y: str, flags: tuple[str, ...], calendar: str = "month") -> DataFrame:
    """(series, period_no, season, y, flags..., trend): one point a series and period. A flag's
    value is the share of the period's lines that carry it (a NULL flag isn't carried),
    the trend counts periods from the series' first."""
    label = month_label(period) if calendar == "month" else fiscal_period(period)
    g = lines.groupBy(F.col(series).alias("series"), label.alias("__label")).agg(
        F.sum(y).cast("double").alias("y"), F.count(F.lit(1)).alias("__n"), *[F.sum(F.coalesce(f, F.lit(0.0))).alias(f) for f in flags])
    year, season = F.substring("__label", 1, 4).cast("int"), label_seq("__label")
    no = year * F.lit(PER_YEAR[calendar]) + season - F.lit(1)
    p = g.select("series", no.alias("period_no"), season.alias("season"), "y", *[(F.col(f) / F.col("__n")).alias(f) for f in flags])
    return p.withColumn("trend", (F.col("period_no") - F.min("period_no").over(Window.partitionBy("series"))).cast("double"))


def _dot(pairs) -> Column:
    out = F.lit(0.0)
    for a, b in pairs:
        out = out + F.col(a) * F.col(b)
    return out


def gram(points: DataFrame, regressors: tuple[str, ...]) -> DataFrame:
    """One row a series: n, seasons, the total sum of squares, and the sums of products within
    seasons of y and the regressors (``s_i_j``, ``s_i_y``, ``s_y_y``)."""
    names = [*regressors, "y"]
    keys = [*map(str, range(len(regressors))), "y"]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    by_season = points.groupBy("series", "season").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"t_{k}") for c, k in zip(names, keys, strict=True)],
        *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"q_{keys[i]}_{keys[j]}") for i, j in pairs])
    within = [F.sum(F.col(f"q_{keys[i]}_{keys[j]}") - F.col(f"t_{keys[i]}") * F.col(f"t_{keys[j]}") / F.col("n"))
              .alias(f"s_{keys[i]}_{keys[j]}") for i, j in pairs]
    total = F.sum("q_y_y") - F.sum("t_y") * F.sum("t_y") / F.sum("n")
    return by_season.groupBy("series").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("seasons"), total.alias("sst"), *within)


def solved(g: DataFrame, regressors: tuple[str, ...], inverse: bool = False) -> DataFrame:
    """Coefficients, standard errors, residual standard error and R^2 from the rows of ``gram``;
    with ``inverse`` also the inverse of the Cholesky factor (``m_i_j``)."""
    p = len(regressors)
    for j in range(p):
        # pivot, its inverse root (0: the regressor is left out), the column of the factor, the right side
        pivot = F.col(f"s_{j}_{j}") - _dot((f"l_{j}_{k}", f"l_{j}_{k}") for k in range(j))
        g = g.withColumn(f"p_{j}", pivot)
        free = (F.col(f"p_{j}") > F.col(f"s_{j}_{j}") * TOLERANCE) & (F.col(f"s_{j}_{j}") > TOLERANCE)
        g = g.withColumn(f"i_{j}", F.when(free, F.lit(1.0) / F.sqrt(f"p_{j}")).otherwise(0.0))
        g = g.withColumns({
            **{f"l_{i}_{j}": (F.col(f"s_{j}_{i}") - _dot((f"l_{i}_{k}", f"l_{j}_{k}") for k in range(j))) * F.col(f"i_{j}")
               for i in range(j + 1, p)},
            f"z_{j}": (F.col(f"s_{j}_y") - _dot((f"l_{j}_{k}", f"z_{k}") for k in range(j))) * F.col(f"i_{j}")})
    for j in reversed(range(p)):
        g = g.withColumn(f"b_{j}", (F.col(f"z_{j}") - _dot((f"l_{i}_{j}", f"b_{i}") for i in range(j + 1, p))) * F.col(f"i_{j}"))
    for j in range(p):  # column j of the factor's inverse: its squares add up to the variance factor
        g = g.withColumn(f"m_{j}_{j}", F.col(f"i_{j}"))
        for i in range(j + 1, p):
            g = g.withColumn(f"m_{i}_{j}", -_dot((f"l_{i}_{k}", f"m_{k}_{j}") for k in range(j, i)) * F.col(f"i_{i}"))
    used = sum((F.when(F.col(f"i_{j}") > 0, 1).otherwise(0) for j in range(p)), F.lit(0))
    sse = F.greatest(F.col("s_y_y") - _dot((f"z_{j}", f"z_{j}") for j in range(p)), F.lit(0.0))
    g = g.select("*", used.alias("used"), sse.alias("sse"))
    dof = F.col("n") - F.col("seasons") - F.col("used")
    g = g.withColumn("resid_se", F.when(dof > 0, F.sqrt(F.col("sse") / dof)))
    error = {c: F.when(F.col(f"i_{j}") > 0, F.col("resid_se") * F.sqrt(_dot((f"m_{i}_{j}", f"m_{i}_{j}") for i in range(j, p))))
             for j, c in enumerate(regressors)}
    return g.select("series", "n", "seasons", "used", *[F.col(f"b_{j}").alias(f"coef_{c}") for j, c in enumerate(regressors)],
                    *[e.alias(f"se_{c}") for c, e in error.items()], "resid_se",
                    (F.lit(1.0) - F.col("sse") / F.nullif("sst", F.lit(0.0))).alias("r2"),
                    *[f"m_{i}_{j}" for j in range(p) for i in range(j, p) if inverse])


def fit(points: DataFrame, regressors: tuple[str, ...]) -> DataFrame:
    """K2 with several regressors: one row a series."""
    return solved(gram(points, regressors), regressors)


def organic_forecast(points: DataFrame, promotions: tuple[str, ...], trend: str | None = "trend", horizon: int = HORIZON,
                     confidence: float | None = None, calendar: str = "month") -> DataFrame:
    """K3/K4 with several regressors: the ``horizon`` periods after each series' last one with
    every promotion at zero and the trend carried on. A step whose season was never seen is
    there with NULL values.

    Bands are +-1.645 residual SE. With a ``confidence`` they are prediction intervals of small
    samples: the quantile of Student's t at the residual degrees of freedom times
    s * sqrt(1 + 1/m + d'S^-1 d), for a season of m points and the distance d of the
    step's regressors from their season means (the leverage, from the inverse factor)."""
    regressors = (*promotions, *([trend] if trend else []))
    model = solved(gram(points, regressors), regressors, inverse=True)
    seasons = points.groupBy("series", "season").agg(F.max("period_no").alias("last"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("m"),
                                                     *[F.avg(c).alias(c) for c in regressors])
    means = F.map_from_entries(F.collect_list(F.struct("season", F.struct("y", "m", *regressors).alias("m"))))  # at most 13
    start = points.groupBy("series").agg(F.min("period_no").alias("first"))
    s = (seasons.groupBy("series").agg(F.max("last").alias("last"), means.alias("means")).join(start, "series").join(model, "series")
         .select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
         .withColumn("no", F.col("last") + F.col("step"))
         .withColumn("season", (F.pmod("no", F.lit(PER_YEAR[calendar])) + 1).cast("int"))
         .withColumn("at", F.try_element_at("means", F.col("season"))))
    s = s.withColumns({f"d_{j}": (F.col("no") - F.col("first") if c == trend else F.lit(0.0)) - F.col(f"at.{c}")
                       for j, c in enumerate(regressors)})
    median = F.col("at.y")
    for j, c in enumerate(regressors):
        median = median + F.col(f"coef_{c}") * F.col(f"d_{j}")
    if confidence is None:
        band = F.lit(Z90) * F.coalesce(F.col("resid_se"), F.lit(0.0))
    else:
        leverage = F.lit(1.0) / F.col("at.m")
        for i in range(len(regressors)):
            part = _dot((f"m_{i}_{j}", f"d_{j}") for j in range(i + 1))
            leverage = leverage + part * part
        dof = F.col("n") - F.col("seasons") - F.col("used")
        band = t_column(dof, confidence) * F.col("resid_se") * F.sqrt(F.lit(1.0) + leverage)
    s = s.select("series", "step", period_text(F.col("no"), calendar).alias("target_period"), "season",
                 median.alias("forecast_median"), band.alias("band"))
    return s.select("series", "step", "target_period", "season", "forecast_median", (F.col("forecast_median") + F.col("band")).alias("forecast_high"),
                    (F.col("forecast_median") - F.col("band")).alias("forecast_low"))

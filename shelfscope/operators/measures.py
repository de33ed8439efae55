"""Market measures: rolling-year sums, shares, cumulative shares, ranks, tiers,
concentration.

All window functions here run on data that has already been aggregated to a
dimension grain (brand or SKU within a market), so a window partition holds at
most the number of brands/SKUs of one market -- bounded by the catalogue, not by
the number of fact rows. Every running window carries a total ordering (the
remaining group keys are appended as tie-breaks) so ranks, running sums and LAG
are deterministic (trap T7).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.functions.numeric import dec0, percent2, ratio, ratio0


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rolling_year(df: DataFrame, keys: list[str], measures: dict[str, tuple[str, str]],
                 year_col: str = "relative_year", case_insensitive: bool = False) -> DataFrame:
    """G1+G2: ``SUM(CASE WHEN year = v THEN m END)`` per output column, one groupBy.

    A year with no rows gives NULL (no ELSE), which downstream YoY logic relies on.
    Partial aggregation runs map-side, so a hot key costs one row per task.
    """
    yc = F.upper(F.col(year_col)) if case_insensitive else F.col(year_col)
    aggs = [F.sum(F.when(yc == F.lit(v.upper() if case_insensitive else v), F.col(m))).alias(name)
            for name, (m, v) in measures.items()]
    return df.groupBy(*keys).agg(*aggs)


def order_desc(*cols: str, tiebreak: tuple[str, ...] = ()) -> list[Column]:
    """``c DESC NULLS LAST`` for each measure, then ascending tie-break keys."""
    return [F.col(c).desc_nulls_last() for c in cols] + [F.col(t).asc_nulls_first() for t in tiebreak]


def total_over(x, keys: list[str]) -> Column:
    """H1: ``SUM(x) OVER (PARTITION BY keys)``."""
    return F.sum(_c(x)).over(Window.partitionBy(*keys))


def share(x, keys: list[str], scale: float = 100.0, default0: bool = True) -> Column:
    """X as a share of its partition total; 0 (or NULL) when the total is 0/NULL."""
    f = ratio0 if default0 else ratio
    return f(x, total_over(x, keys), scale)


def running_sum(x, keys: list[str], order: list[Column]) -> Column:
    """H2: ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.sum(_c(x)).over(w)


def cum_share(x, keys: list[str], order: list[Column], scale: float = 100.0) -> Column:
    """Running total of x over the ordering, as a share of the partition total."""
    return ratio0(running_sum(x, keys, order), total_over(x, keys), scale)


def row_number(keys: list[str], order: list[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def rank(keys: list[str], order: list[Column]) -> Column:
    """H5: RANK keeps ties (several rank-1 rows are visible semantics)."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(*order))


def lagged(x, keys: list[str], order: list[Column], default0: bool = False) -> Column:
    """H3/H4: previous row's value; ``default0`` wraps it in COALESCE(.., 0), which
    also covers a NULL previous value (unlike LAG's own default)."""
    v = F.lag(_c(x)).over(Window.partitionBy(*keys).orderBy(*order))
    return F.coalesce(v, F.lit(0.0)) if default0 else v


def tier(lag_cum, t1: float = 50.0, t2: float = 80.0, inclusive: bool = False) -> Column:
    """Volume tier from the previous row's cumulative share.

    strict (market outlook): NULL or < t1 -> 1, < t2 -> 2, else 3.
    inclusive (flagship):    <= t1 -> 1, <= t2 -> 2, else 3 (NULL -> 3; callers pass a
    COALESCEd lag).
    """
    c = _c(lag_cum)
    if inclusive:
        return F.when(c <= t1, 1).when(c <= t2, 2).otherwise(3)
    return F.when(c.isNull() | (c < t1), 1).when(c < t2, 2).otherwise(3)


def hhi(share_col) -> Column:
    """Herfindahl-Hirschman index = sum of squared percent shares, rounded."""
    return dec0(F.sum(F.pow(_c(share_col), F.lit(2.0))))


def concentration_ratio(k: int, rank_col, vol_col) -> Column:
    """CR_k = volume of the top-k ranked brands as % of the market, 2 dp."""
    top = F.sum(F.when(_c(rank_col) <= k, _c(vol_col)))
    return percent2(top, F.sum(_c(vol_col)))


def at_rank(rank_col, value, r: int = 1) -> Column:
    """``MAX(CASE WHEN rank = r THEN value END)`` -- argmax pivot."""
    return F.max(F.when(_c(rank_col) == r, _c(value)))


def at_entity(cond: Column, value, agg: str = "max", default=0) -> Column:
    """Pick one entity's value by predicate, defaulting when absent."""
    fn = {"max": F.max, "sum": F.sum}[agg]
    v = fn(F.when(cond, _c(value)))
    return v if default is None else F.coalesce(v, F.lit(default))


def sum_when(cond: Column, value) -> Column:
    """Conditional SUM with no ELSE (NULL when nothing matches)."""
    return F.sum(F.when(cond, _c(value)))


def count_when(cond: Column, value) -> Column:
    """COUNT(CASE WHEN cond THEN value END): counts matching non-NULL values."""
    return F.count(F.when(cond, _c(value)))


def global_row_number(df: DataFrame, value: str, tiebreak: tuple[str, ...] = (), out: str = "rn",
                      buckets: int = 64) -> DataFrame:
    """Exact ``ROW_NUMBER() OVER (ORDER BY value DESC NULLS LAST, tiebreak...)`` over a
    whole DataFrame without moving every row into one task.

    Rows are bucketed by ``value`` between its approximate quantiles (one scalar
    subquery of ``buckets - 1`` numbers), so buckets are even however skewed the values
    are. The bucket is a monotone pure function of the value, so equal values share a
    bucket and bucket order follows value order; the approximation moves only the
    bounds, never a rank. Each bucket is ranked on its own (parallel window); a bucket's
    offset is the running count of the buckets before it -- a window over at most
    ``buckets + 1`` rows, broadcast back (size bound: one row per bucket).
    """
    v = F.col(value).cast("double")
    shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    bounds = df.select(F.percentile_approx(v, shares, F.lit(1000))).scalar()
    bucket = F.when(v.isNull(), F.lit(buckets)).otherwise(F.size(F.filter("__bounds", lambda b: b > v)))
    d = df.withColumn("__bounds", bounds).withColumn("__bucket", bucket).drop("__bounds")
    order = [F.col(value).desc_nulls_last()] + [F.col(t).asc_nulls_first() for t in tiebreak]
    ranked = d.withColumn("__local", F.row_number().over(Window.partitionBy("__bucket").orderBy(*order)))
    counts = d.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    return (ranked.join(F.broadcast(offsets), "__bucket")
                  .withColumn(out, (F.col("__off") + F.col("__local")).cast("int"))
                  .drop("__bucket", "__local", "__off"))

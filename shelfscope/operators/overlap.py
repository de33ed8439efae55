"""Apportionment between the two retail calendars by the days that periods share.

The calendars' labels can be mapped to a year and a season number, but month 7 and
four-week period 7 aren't the same weeks. To compare seasons across calendars, what was
sold in a period is spread evenly over its days and regrouped by the periods of one target
calendar.

A period of D days that shares its days b+1..e with a target period (counted from the
period's start) passes on cut(e) - cut(b), where cut(k) is k/D of the amount, rounded half
away from zero at ``DIGITS`` decimals. The cuts telescope: the parts of a period add up to
exactly its amount, for every row that is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.functions.calendar import label_end, label_of, label_ordinal, label_start, ordinal_label

#: Decimals that amounts are kept to (those of the sales view's volumes and revenue).
DIGITS = 4


def overlap_of(rows: DataFrame) -> DataFrame:
    """``rows`` with the bounds of their label."""
    return rows.select("*", label_start("period_code").alias("__start"), label_end("period_code").alias("__end"))


def seasons_of(kind: str) -> tuple[Column, Column]:
    """Positions of the first and the last period of ``kind`` that share days with a label."""
    return tuple(label_ordinal(label_of(d, kind)) for d in (F.col("__start"), F.date_sub(F.col("__end"), 1)))


def shared_days() -> tuple[Column, Column]:
    """How many days of a label come before those that it shares with its season, and how many it shares."""
    s = F.col("season_code")
    lo, hi = F.greatest("__start", label_start(s)), F.least("__end", label_end(s))
    return F.datediff(lo, "__start"), F.datediff(hi, lo)


def period_overlap(labels: DataFrame, kind: str, label_col: str = "period_code") -> DataFrame:
    """(period_code, season_code, days_before, days, period_days): for each distinct label, the
    periods of the calendar ``kind`` that share days with it, how many days of the label
    come before the shared ones, how many are shared, and how many it has. A label of that
    calendar itself gets one row, itself. A few rows a label, computed from the label alone."""
    one = overlap_of(labels.select(F.col(label_col).alias("period_code")).distinct())
    many = one.select("*", F.explode(F.sequence(*seasons_of(kind))).alias("__at")).withColumn("season_code", ordinal_label(F.col("__at"), kind))
    before, days = shared_days()
    return many.select("period_code", "season_code", before.alias("days_before"), days.alias("days"),
                       F.datediff("__end", "__start").alias("period_days"))


def cut(amount: Column, days: Column, period_days: Column, digits: int = DIGITS) -> Column:
    """``days / period_days`` of a decimal amount, half away from zero at ``digits`` decimals,
    by integers: 10^digits of the amount times twice the days must fit 38 digits."""
    units = (F.abs(amount).cast(f"decimal(28,{digits})") * F.lit(10 ** digits)).cast("decimal(32,0)")
    twice = units * (days * 2).cast("decimal(5,0)") + period_days.cast("decimal(5,0)")
    whole = F.call_function("div", twice, (period_days * 2).cast("decimal(5,0)"))
    return (F.when(amount < 0, -whole).otherwise(whole).cast("decimal(28,0)") / F.lit(10 ** digits).cast("decimal(6,0)")).cast(
        f"decimal(28,{digits})")


def spread(sales: DataFrame, kind: str, amounts: tuple[str, ...], keys: tuple[str, ...]) -> DataFrame:
    """``keys``, ``period_code``, ``season_code``, ``days`` and the ``amounts`` that each period
    of ``sales`` passes on to each season of the calendar ``kind``.

    Sales are summed by key and period before they are spread, so a hot key costs one row
    a task and a period, and what is spread is bounded by the keys, not by the facts. A NULL
    amount stays NULL; a row without a period, or with
    one that is no label, is in no season. Which seasons a row belongs to is computed from
    its own label, so there is no join.
    """
    label = F.col("period_code").rlike(r"^[0-9]{4}(M(0[1-9]|1[0-2])|P(0[1-9]|1[0-3]))$")
    summed = sales.where(label).groupBy(*keys, "period_code").agg(*[F.sum(a).alias(a) for a in amounts])
    rows = overlap_of(summed).select("*", F.explode(F.sequence(*seasons_of(kind))).alias("__at")).withColumn("season_code", ordinal_label(F.col("__at"), kind))
    before, days = shared_days()
    n = F.datediff("__end", "__start")
    return rows.select(*keys, "period_code", "season_code", days.alias("days"),
                       *[(cut(F.col(a), before + days, n) - cut(F.col(a), before, n)).alias(a) for a in amounts])


def apportioned(sales: DataFrame, kind: str, amounts: tuple[str, ...], keys: tuple[str, ...]) -> DataFrame:
    """``keys``, ``season_code`` and the ``amounts`` of ``sales`` regrouped by the calendar
    ``kind``, whichever calendar each row's ``period_code`` is of (see ``spread``). Each
    key's totals over all seasons are exactly those of ``sales``."""
    return spread(sales, kind, amounts, keys).groupBy(*keys, "season_code").agg(*[F.sum(a).alias(a) for a in amounts])


def covered_days(sales: DataFrame, kind: str, keys: tuple[str, ...]) -> DataFrame:
    """(keys, season_code, covered_days, season_days): on how many days of a season each key
    reported at all, from the distinct periods of its rows."""
    seen = sales.select(*keys, "period_code").distinct()
    s = F.col("season_code")
    return (seen.join(period_overlap(seen, kind), "period_code").groupBy(*keys, "season_code")
            .agg(F.sum("days").cast("int").alias("covered_days"))
            .withColumn("season_days", F.datediff(label_end(s), label_start(s))))



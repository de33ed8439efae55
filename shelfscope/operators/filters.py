"""Predicates used by the reports. Plain column predicates on scan columns reach the
parquet reader as PushedFilters; predicates over derived columns run right after
the projection that creates them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.functions.text import ieq
from shelfscope.operators.measures import row_number


def where_origin(df: DataFrame, origin: str) -> DataFrame:
    """Case-insensitive origin equality."""
    return df.filter(ieq("origin", origin))


def where_market(df: DataFrame, origin: str, exc_varietal: str, exc_origin: str,
                 portfolio_col: str | None = None) -> DataFrame:
    """Home origin (optionally only portfolio varietals) OR the exception pair."""
    from shelfscope.operators.conform import market_filter

    return df.filter(market_filter(origin, exc_varietal, exc_origin, portfolio_col))


def where_format(df: DataFrame, unit_size: int | None) -> DataFrame:
    """D6."""
    return df if unit_size is None else df.filter(F.col("unit_size") == F.lit(unit_size))


def where_varietal(df: DataFrame, varietal: str | None) -> DataFrame:
    """D7."""
    return df if varietal is None else df.filter(F.col("varietal") == F.lit(varietal))


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, col: str = "rn") -> DataFrame:
    """Keep the first ``n`` rows per partition. Spark plans a
    ``WindowGroupLimit`` below the shuffle for this shape, so each task forwards at
    most ``n`` rows per key (a map-side top-k)."""
    return df.withColumn(col, row_number(keys, order)).filter(F.col(col) <= n)


def share_cutoff(df: DataFrame, lag_col: str, pct: float) -> DataFrame:
    """Keep rows whose lagged cumulative share is within the cut-off (inclusive)."""
    return df.filter(F.col(lag_col) <= F.lit(float(pct)))

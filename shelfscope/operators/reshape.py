"""Reshape, set operations and data-quality profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from shelfscope.functions.numeric import round2


def melt(df: DataFrame, ids: list[str], values: list[str], var: str = "sale_period",
         val: str = "sale_actual_cases", round_values: bool = True) -> DataFrame:
    """Wide period columns -> long rows; NULL values are kept (one row per
    (id, period)). ``round_values`` applies the NumPy-style 2-dp rounding of B18."""
    long = df.unpivot(ids, values, var, val)
    return long.withColumn(val, round2(val)) if round_values else long


def union_all(*dfs: DataFrame) -> DataFrame:
    """UNION ALL by column name (missing columns become NULL)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def null_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """C4: NULL count per column in one aggregate pass, returned long
    (column_name, null_count)."""
    cols = cols or df.columns
    wide = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).cast("long").alias(c) for c in cols])
    return wide.unpivot([], cols, "column_name", "null_count")


def counted(steps: dict[str, DataFrame]) -> DataFrame:
    """(step, rows): the rows that each step's own result holds, so a step that drops or
    multiplies rows where it shouldn't shows. Steps that share work share its exchanges."""
    return reduce(DataFrame.unionByName, [df.agg(F.lit(n).alias("step"), F.count(F.lit(1)).alias("rows")) for n, df in steps.items()])


class Observed:
    """C5 while the steps run: ``watch(step, df)`` passes ``df`` on and counts its rows, and the
    rows with a NULL in any of ``cols``, in whatever action runs the step first, such as the
    write of the cleaned table. No pass of its own reads the data.

    A step is counted by the first action that holds it; ``counts`` waits for that action.
    Tasks that run again after an executor is lost count again in steps below a shuffle, so
    these are counts for watching a load; ``counted`` is the exact form.
    """

    def __init__(self) -> None:
        self._seen: dict[str, Observation] = {}

    def watch(self, step: str, df: DataFrame, cols: tuple[str, ...] = ()) -> DataFrame:
        if step in self._seen:
            raise ValueError(f"step {step!r} is watched already")
        self._seen[step] = Observation(step)
        missing = F.lit(False)
        for c in cols:
            missing = missing | F.col(f"`{c}`").isNull()
        return df.observe(self._seen[step], F.count(F.lit(1)).alias("rows"), F.count_if(missing).alias("rows_with_null"))

    def counts(self) -> dict[str, dict[str, int]]:
        return {step: dict(o.get) for step, o in self._seen.items()}

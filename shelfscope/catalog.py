"""Registry of named queries over a test-data directory.

Each entry is ``name -> (fn(spark, sf_dir) -> DataFrame, doubles, ints)``. The
``doubles``/``ints`` lists drive one output normalisation shared with the DuckDB
oracle: decimals become doubles, every listed double is rounded half-away at 6
decimals (``round(x * 1e6) / 1e6``, bit-identical in both engines) and integral
columns become BIGINT.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfscope.functions.numeric import round_half_away

OUT_DIGITS = 6


@dataclass(frozen=True)
class Query:
    fn: Callable[[SparkSession, str], DataFrame]
    doubles: tuple[str, ...] = ()
    ints: tuple[str, ...] = ()


def normalise(df: DataFrame, q: Query) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in q.doubles or isinstance(f.dataType, (T.DecimalType, T.FloatType)):
            c = round_half_away(c.cast("double"), OUT_DIGITS)
        elif f.name in q.ints or isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)


REGISTRY: dict[str, Query] = {}


def register(name: str, doubles=(), ints=()):
    def deco(fn):
        REGISTRY[name] = Query(fn, tuple(doubles), tuple(ints))
        return fn
    return deco


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    q = REGISTRY[name]
    return normalise(q.fn(spark, sf_dir), q)

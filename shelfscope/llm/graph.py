"""Connected components as a series of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from shelfscope.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of the ``a``, ``b`` edges; a component's name is its
    smallest id. Alternates the two public star steps: each node's larger neighbours, then
    its smaller ones, move to its smallest neighbour, until nothing changes. Each step is
    an aggregate and a join on ids, written to the shared folder; nothing is collected but
    a count and a checksum. A hub's edges are pre-aggregated to one row a task before its
    minimum is shuffled, and the join of a hub is split by AQE's skew join.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
               "cc-edges")
    before = None
    while True:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))).distinct())
        # count and checksum are taken while the step is written; counted twice, they only cost a step
        seen = Observation()
        e = stored(small.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % (1 << 31)).alias("sum")), "cc-edges")
        now = (seen.get["n"], seen.get["sum"])
        if now == before:
            break
        before = now
    return stored(e.select(F.col("u").alias("id"), F.col("v").alias("component"))
                  .union(e.select("v", "v")).distinct(), "cc-components")

"""Deliveries merged into a partitioned table: a corrected period replaces what it corrects.

A delivery holds whole keys (a product's period, say). Its rows take the place of the stored
rows with the same keys; other rows of the partitions that it touches are carried over, and
partitions that it doesn't touch are neither read nor written. Delivering the same
rows again changes nothing.

The merged partitions are written beside the table first (``<path>__pending``) and then take
their places in it (dynamic partition overwrite). A run that was lost in between is
finished by the next one before it does anything else, so no partition stays half replaced.
One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.sources.tables import require_columns


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def latest(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """One row for each key, the last by ``order`` (columns that go). Partially aggregated,
    so a key that was delivered very often costs one row a task."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col("__r")[c].alias(c) for c in rest])


def merge_partitions(delivered: DataFrame, path: str, keys: tuple[str, ...], partition_by: tuple[str, ...]) -> None:
    """Merge ``delivered``, with one row a key, into the Parquet table at ``path``. The
    partition columns are part of the keys: a key can't move to another partition. A NULL key
    matches a NULL key."""
    spark = delivered.sparkSession
    require_columns(delivered.columns, list(keys), "the delivery")
    if set(partition_by) - set(keys):
        raise ValueError("the partition columns must be keys")
    pending = f"{path.rstrip('/')}__pending"
    schema = delivered.schema
    if exists(spark, f"{pending}/_SUCCESS"):  # completely staged, and then lost
        _apply(spark.read.schema(schema).parquet(pending), path, partition_by)
    merged = delivered
    if exists(spark, path):
        stored = spark.read.schema(schema).parquet(path)
        touched = delivered.select(*partition_by).distinct()
        same = [F.col(f"s.{c}").eqNullSafe(F.col(f"d.{c}")) for c in keys]
        part = [F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}")) for c in partition_by]
        kept = (stored.alias("s").join(touched.alias("t"), part, "left_semi").alias("s")
                .join(delivered.select(*keys).alias("d"), same, "left_anti"))
        merged = kept.select(*delivered.columns).unionByName(delivered)
    merged.write.mode("overwrite").parquet(pending)
    staged = spark.read.schema(schema).parquet(pending)
    _apply(staged, path, partition_by)
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(pending)  # done


def _apply(merged: DataFrame, path: str, partition_by: tuple[str, ...]) -> None:
    (merged.hint("rebalance", *partition_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_by).parquet(path))

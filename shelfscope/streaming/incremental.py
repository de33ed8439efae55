"""Incremental ingestion of newly delivered wide period files.

The reference cleans provincial files in batch. The same cleaning runs here as a
Structured Streaming job over a landing folder: ``readStream`` with the explicit
wide schema (no inference), ``trigger(availableNow=True)`` to process whatever has
arrived and stop, and ``foreachBatch`` applying the batch ETL to each micro-batch.

Files are read by the same rules as in batch (columns by the header's names, a value that
doesn't fit fails the batch). Products and sales are merged into their tables
(``sources.merge``): a product delivered again, in the same micro-batch or a later one,
replaces its row and the periods of its layout, so a corrected or repeated delivery is
counted once and only the touched partitions are rewritten. A retried batch merges the
same rows again, which changes nothing. The streaming checkpoint lives under the
session's shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from shelfscope.plans import etl as ETL
from shelfscope.sources.merge import latest, merge_partitions
from shelfscope.sources.tables import CHECKED_CSV, RAW_ATTRIBUTES, file_schema, wide_schema

DELIVERED = ("__time", "__file")


def ingest_wide(spark: SparkSession, landing: str, out: str, spec: ETL.CalendarSpec, colors: DataFrame,
                bands: list[tuple[str, float, float]], province_col: str = "province_code", fmt: str = "csv",
                checkpoint: str | None = None, max_files_per_trigger: int | None = None):
    """Start an availableNow stream from ``landing`` into ``out/{products,sales}``.

    Returns the started ``StreamingQuery``; callers ``awaitTermination()``.
    Input files carry a ``province_code`` column (one folder per province, or the
    column itself in the file).
    """
    schema = wide_schema({province_col: T.StringType(), **RAW_ATTRIBUTES}, list(spec.period_labels))
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        stream = reader.schema(file_schema(spark, landing, schema)).options(**CHECKED_CSV).csv(landing)
    else:
        stream = reader.schema(schema).format(fmt).load(landing)
    stream = stream.selectExpr(*[f"`{c}`" for c in schema.names],
                               "_metadata.file_modification_time AS __time", "_metadata.file_path AS __file")

    base = checkpoint or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("no checkpoint location: set spark.checkpoint.dir to a shared folder")

    # one checkpoint for each landing folder and output
    name = hashlib.sha256(f"{landing}\n{out}".encode()).hexdigest()[:16]

    def process(batch: DataFrame, batch_id: int) -> None:
        raw = latest(ETL.keyed(batch.withColumnRenamed(province_col, "province_code")), ("province_code", "global_code"), DELIVERED)
        raw = raw.persist()  # both outputs read it
        try:
            rows = ETL.enriched(ETL.cleaned_attributes(raw, spec), colors, bands, spec)
            ids = ("province_code", "global_code")
            merge_partitions(ETL.conform_products(ETL.products_of(rows)), f"{out}/products", ids, ids[:1])
            merge_partitions(ETL.sales_of(rows, spec, ids), f"{out}/sales", (*ids, "sale_period"), ("province_code", "sale_period"))
        finally:
            raw.unpersist()

    return (stream.writeStream.foreachBatch(process)
            .option("checkpointLocation", f"{base.rstrip('/')}/ingest_wide-{name}")
            .trigger(availableNow=True).start())

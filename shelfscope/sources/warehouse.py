"""Materialised conformed sales table.

Building the conformed view joins the fact table to three large dimensions (order ->
province, part -> product attributes, supplier -> origin): three shuffles of the
fact side. A production deployment runs that once per load and stores the result
partitioned by ``period_code``. Reports read it with the rolling-year labels
(report parameters, known before planning) as a partition filter, so only the two
years' partitions are listed and read -- no fact-side joins at report time.

The bucketed form stores sales and products by the same hash of the product. SKU sums
group by the product among others and join products on it, so neither side of either
is shuffled: the one shuffle was made when the tables were written.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SALES_COLUMNS = ["province_code", "varietal", "unit_size", "brand", "product_code", "product_name",
                 "price_segment", "origin", "period_code", "sale_9l_case", "revenue"]


def write_conformed_sales(view: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store the conformed view partitioned by period. Tasks follow the size of each period
    (AQE's rebalancing) and sort their rows by the common report keys, which keeps parquet
    min/max statistics selective for province / varietal predicates."""
    (view.hint("rebalance", "period_code").sortWithinPartitions("period_code", "province_code", "varietal", "brand")
         .write.mode(mode).partitionBy("period_code").parquet(path))


def read_conformed_sales(spark: SparkSession, path: str, period_labels: list[str] | None = None) -> DataFrame:
    """Read the stored view; ``period_labels`` becomes a static partition filter
    (exact in front of the reports' inner join to the period dim)."""
    df = spark.read.parquet(path)
    if period_labels:
        df = df.filter(F.col("period_code").isin(*period_labels))
    return df.select(*[F.col(c) for c in SALES_COLUMNS])


def write_bucketed(view: DataFrame, products: DataFrame, sales_table: str, products_table: str, path: str,
                   buckets: int = 8) -> None:
    """Store the conformed view and the product dim as tables bucketed by product code, with
    their files below ``path`` (a folder that all executors share). Take ``buckets`` so that one
    holds some hundred MB of a report's periods. A product's rows share a bucket, and products
    are many, so a bucket is even unless one product sells most of everything.

    Rows are dealt by the bucket's own hash before they are written, so each task writes one
    bucket, and there are as many files a period as buckets.
    """
    (view.select(*SALES_COLUMNS).repartition(buckets, "product_code").write.mode("overwrite").option("path", f"{path}/sales")
         .partitionBy("period_code").bucketBy(buckets, "product_code").sortBy("product_code").saveAsTable(sales_table))
    (products.repartition(buckets, "global_code").write.mode("overwrite").option("path", f"{path}/products")
             .bucketBy(buckets, "global_code").sortBy("global_code").saveAsTable(products_table))


def open_bucketed(spark: SparkSession, sales_table: str, products_table: str,
                  period_labels: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(sales, products) of the bucketed store; ``period_labels`` as in ``read_conformed_sales``."""
    sales = spark.table(sales_table)
    if period_labels:
        sales = sales.filter(F.col("period_code").isin(*period_labels))
    return sales.select(*SALES_COLUMNS), spark.table(products_table)


def attach_bucketed(spark: SparkSession, sales_table: str, products_table: str, path: str, view: DataFrame,
                    products: DataFrame, buckets: int = 8) -> None:
    """Name the stored tables in a session whose catalog doesn't know them; the frames give
    the columns' types, and ``buckets`` is the number they were written with."""
    def types(df: DataFrame, cols: list[str]) -> str:
        return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols)

    def create(name: str, columns: str, parted: str, key: str, folder: str) -> None:
        at = re.sub(r"(['\\])", r"\\\1", f"{path}/{folder}")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet {parted} "
                  f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{at}'")

    create(sales_table, types(view, SALES_COLUMNS), "PARTITIONED BY (period_code)", "product_code", "sales")
    spark.sql(f"MSCK REPAIR TABLE {sales_table}")
    create(products_table, types(products, products.columns), "", "global_code", "products")

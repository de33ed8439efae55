"""Writers for the cleaned tables and report outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.params import MarketParams
from shelfscope.sources.tables import require_columns

# Presentation labels (fixed values for BI import), in the reports' order.
BENCHMARK_LABELS = {
    "province_name": "Province",
    "varietal": "Varietal",
    "varietal_total_volume": "Varietal - Total Volume",
    "varietal_yoy_volume_growth": "Varietal - YoY Volume Growth %",
    "varietal_market_share_in_province": "Varietal - Market Share in Province %",
    "varietal_rank_by_volume_in_province": "Varietal - Rank by Volume in Province",
    "top_origin": "Top Origin",
    "top_origin_total_volume": "Top Origin - Total Volume",
    "top_origin_yoy_volume_growth": "Top Origin - YoY Volume Growth %",
    "top_origin_market_share": "Top Origin - Market Share %",
    "home_origin_total_volume": "{origin} Origin - Total Volume",
    "home_origin_yoy_volume_growth": "{origin} Origin - YoY Volume Growth %",
    "home_origin_market_share": "{origin} Origin - Market Share %",
    "market_leader_brand_origin": "Market Leader Brand - Origin",
    "market_leader_brand": "Market Leader Brand",
    "market_leader_brand_total_volume": "Market Leader Brand - Total Volume",
    "market_leader_brand_yoy_volume_growth": "Market Leader Brand - YoY Volume Growth %",
    "market_leader_brand_market_share": "Market Leader Brand - Market Share %",
    "home_origin_top_brand": "{origin} Origin Top Brand",
    "home_origin_top_brand_total_volume": "{origin} Origin Top Brand - Total Volume",
    "home_origin_top_brand_yoy_volume_growth": "{origin} Origin Top Brand - YoY Volume Growth %",
    "home_origin_top_brand_market_share": "{origin} Origin Top Brand - Market Share %",
    "focal_total_volume": "{focal} - Total Volume",
    "focal_yoy_volume_growth": "{focal} - YoY Volume Growth %",
    "focal_market_share": "{focal} - Market Share %",
    "focal_presence": "{focal} - Presence",
}
TOP_SKU_LABELS = {"volume_growth_frac": "Volume Growth %", "market_share_pct": "Market Share %"}


def labels_for(p: MarketParams, labels: dict[str, str] = BENCHMARK_LABELS) -> dict[str, str]:
    """The labels with the report's home origin and focal brand filled in."""
    return {c: x.format(origin=p.origin, focal=p.focal_brand) for c, x in labels.items()}


def write_products(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """A5: product dimension. CSV output keeps a header and UTF-8 like the reference;
    parquet is the default for downstream Spark jobs."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).option("encoding", "UTF-8").csv(path)
    else:
        w.format(fmt).save(path)


def write_sales(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: tuple[str, ...] = ("province_code",)) -> None:
    """Long sales fact, partitioned so reports prune by province. Tasks follow the size of
    what is written: AQE's rebalancing splits a province that holds most of the rows over
    several tasks and puts small ones together. A missing partition column is an error."""
    require_columns(df.columns, [*partition_by, "global_code"], "the sales table")
    w = df.hint("rebalance", *partition_by).write.mode(mode).partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def presentation(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Rename snake_case columns to the report's presentation labels."""
    return df.select(*[F.col(c).alias(labels.get(c, c)) for c in df.columns])


def publish(df: DataFrame, path: str, labels: dict[str, str] | None = None, mode: str = "overwrite") -> None:
    """Analysis-ready table for BI import (parquet; spaces and % are legal names)."""
    (presentation(df, labels) if labels else df).write.mode(mode).parquet(path)

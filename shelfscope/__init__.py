"""shelfscope: market-structure analytics for retail sales on Spark DataFrames.

Layers
------
``sources``    readers, writers and the proxy market over the TPC-H-like test tables
``functions``  column-expression helpers (text cleaning, numeric coercion, calendars)
``operators``  DataFrame -> DataFrame building blocks (cleaning, reshape, conform,
               filters, market measures, position labels)
``plans``      composed reports: market outlook, flagship pricing, varietal
               benchmark, top SKUs, ETL, insights, organic demand forecast
``streaming``  incremental ingestion of newly arrived period files

Everything is expressed with built-in Spark SQL expressions so Catalyst can push
filters and prune columns, and whole-stage codegen covers the hot path.
"""

from shelfscope.params import MarketParams

__all__ = ["MarketParams"]
__version__ = "0.1.0"

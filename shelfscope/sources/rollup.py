"""Sales by brand and period: a small table that reports read in place of the fact.

Sums are mergeable, so the fact is aggregated once a delivery, to one row for each market,
format, brand, origin and period, and that period's partition is replaced. A report over
the stored rows reads two years of partitions and no fact; it gives the same sums, because
the reports' base aggregates by the same columns.

**Rolling forward.** The sums of the two rolling years are kept as a table of their own. When
the anchor moves on, a period enters this year, one passes from this year to the last, and
the oldest leaves: only those three periods are read, added or taken away. The sums are
exact decimals, and each year's number of lines goes with them, so a brand without lines in
a year has NULL there, as an aggregate over the fact has, and one without any is gone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.functions.calendar import FISCAL_PERIODS, MONTHS, python_labels
from shelfscope.operators.conform import market_filter, with_portfolio
from shelfscope.params import MarketParams

KEYS = ("province_code", "varietal", "unit_size", "brand", "origin")
SUMS = ("sale_9l_case", "revenue")


def period_rollup(sales: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The sales view's sums and its number of lines by ``keys`` and period."""
    return sales.groupBy(*keys, "period_code").agg(*[F.sum(c).alias(c) for c in SUMS], F.count(F.lit(1)).alias("lines"))


def write_rollup(rollup: DataFrame, path: str) -> None:
    """Replace the periods that ``rollup`` holds, and no others. Tasks follow the size of what
    is written: AQE's rebalancing splits a large period and puts small ones together."""
    (rollup.hint("rebalance", "period_code").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("period_code").parquet(path))


def read_rollup(spark: SparkSession, path: str, labels: list[str] | None = None) -> DataFrame:
    """The stored rows of some periods (a static partition filter), or of all of them."""
    df = spark.read.parquet(path)
    return df if labels is None else df.where(F.col("period_code").isin(*labels))


def year_labels(anchors: dict[str, str]) -> tuple[list[str], list[str]]:
    """(last year's labels, this year's) of every calendar that has an anchor."""
    last, this = [], []
    for kind, anchor in anchors.items():
        n = FISCAL_PERIODS if kind == "P" else MONTHS
        labels = python_labels(kind, anchor, 2 * n)
        last, this = last + labels[:n], this + labels[n:]
    return last, this


def _signed(rollup: DataFrame, keys: tuple[str, ...], steps: list[tuple[list[str], str, int]]) -> DataFrame:
    """Each row of the labels of a step, once, under its year and with its sign."""
    label = F.col("period_code")
    moves = F.array_compact(F.array(*[F.when(label.isin(*labels), F.struct(F.lit(year).alias("year"), F.lit(sign).alias("sign")))
                                      for labels, year, sign in steps if labels]))
    used = sorted({x for labels, _, _ in steps for x in labels})
    m = rollup.where(label.isin(*used)).select(*keys, *SUMS, "lines", F.explode(moves).alias("m"))
    return m.select(*keys, *[F.when(F.col("m.year") == y, F.col(c) * F.col("m.sign")).alias(f"{c}_{y}")
                             for y in ("ly", "ty") for c in (*SUMS, "lines")])


def _totals(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    g = df.groupBy(*keys).agg(*[F.coalesce(F.sum(f"lines_{y}"), F.lit(0)).alias(f"lines_{y}") for y in ("ly", "ty")],
                              *[F.sum(f"{c}_{y}").alias(f"{c}_{y}") for y in ("ly", "ty") for c in SUMS])
    return g.where("lines_ly + lines_ty > 0").select(
        *keys, "lines_ly", "lines_ty", *[F.when(F.col(f"lines_{y}") > 0, F.col(f"{c}_{y}")).alias(f"{c}_{y}") for y in ("ly", "ty") for c in SUMS])


def year_state(rollup: DataFrame, anchors: dict[str, str], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Sums and lines of the two rolling years that end with ``anchors`` (calendar -> label)."""
    last, this = year_labels(anchors)
    return _totals(_signed(rollup, keys, [(last, "ly", 1), (this, "ty", 1)]), keys)


def moved_labels(old: dict[str, str], new: dict[str, str]) -> list[tuple[list[str], str, int]]:
    """(labels, year, sign) of what changes when the anchors move from ``old`` to ``new``."""
    before, after = year_labels(old), year_labels(new)
    return [(sorted(set(a) - set(b)), year, 1) for year, b, a in zip(("ly", "ty"), before, after)] + \
           [(sorted(set(b) - set(a)), year, -1) for year, b, a in zip(("ly", "ty"), before, after)]


def rolled_forward(state: DataFrame, rollup: DataFrame, old: dict[str, str], new: dict[str, str], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``state`` at the anchors ``new``, from the one at ``old`` and the rows of the periods that
    enter, change years or leave; no other period is read. ``new`` may be any number of
    periods on, or back. A correction of a period must be rolled in by a new state."""
    if old == new:
        return state
    delta = _signed(rollup, keys, moved_labels(old, new))
    return _totals(state.select(delta.columns).unionByName(delta), keys)


def base_of_state(state: DataFrame, varietals: DataFrame, p: MarketParams) -> DataFrame:
    """J1 from the two years' sums: what ``outlook.brand_base`` gives from the fact."""
    s = state if p.unit_size is None else state.where(F.col("unit_size") == p.unit_size)
    s = with_portfolio(s, varietals).where(market_filter(p.origin, p.exception_varietal, p.exception_origin, "in_portfolio"))
    names = {"sale_vol_ly": "sale_9l_case_ly", "sale_vol_ty": "sale_9l_case_ty", "revenue_ly": "revenue_ly", "revenue_ty": "revenue_ty"}
    return s.groupBy("province_code", "varietal", "brand").agg(*[F.sum(c).alias(n) for n, c in names.items()])

"""Conformed layer: period analogy and the standard dimension joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.functions.calendar import FISCAL_PERIODS, MONTHS, label_kind, label_ordinal, label_seq
from shelfscope.functions.text import ieq, match_key, match_text


def period_analogy(labels: DataFrame, anchors: dict[str, str], label_col: str = "period_code",
                   this_year: str = "TRY", last_year: str = "LRY", distinct: bool = True) -> DataFrame:
    """Map period labels of both calendars to a relative year and a season.

    ``anchors`` gives, per calendar kind ('M' monthly, 'P' fiscal), the last label of
    the current rolling year. A label ``k`` steps before its anchor (k >= 0) is in the
    current year when ``k < periods_per_year`` and in the previous year when
    ``k < 2 * periods_per_year``; other labels are not part of the analogy (dropped).
    Season is the month / fiscal period number. ``distinct=False`` skips the
    de-duplication when the labels are already unique (a literal label list).
    """
    kind = label_kind("period_code")
    per_year = F.when(kind == "P", F.lit(FISCAL_PERIODS)).otherwise(F.lit(MONTHS))
    anchor_ord = None
    for k, a in anchors.items():
        ord_a = (int(a[:4]) * (FISCAL_PERIODS if k == "P" else MONTHS)) + int(a[5:])
        anchor_ord = (F.when(kind == k, F.lit(ord_a)) if anchor_ord is None
                      else anchor_ord.when(kind == k, F.lit(ord_a)))
    dist = anchor_ord - label_ordinal("period_code")
    rel = (F.when((dist >= 0) & (dist < per_year), F.lit(this_year))
             .when((dist >= per_year) & (dist < per_year * 2), F.lit(last_year)))
    lab = labels.select(F.col(label_col).alias("period_code"))
    if distinct:
        lab = lab.distinct()
    return (lab.select("period_code", rel.alias("relative_year"),
                          label_seq("period_code").alias("season"),
                          F.when(kind == "P", F.lit("fiscal")).otherwise(F.lit("monthly")).alias("calendar"))
                  .filter(F.col("relative_year").isNotNull()))


def with_relative_year(sales: DataFrame, periods: DataFrame, how: str = "inner") -> DataFrame:
    """Attach ``relative_year`` via the period dim. Inner drops unmapped periods (E1);
    left keeps them with a NULL year (E2). The dim is bounded by the calendar (two
    rolling years of labels), so it is broadcast."""
    dim = F.broadcast(periods.select("period_code", "relative_year"))
    return sales.join(dim, "period_code", how)


def with_price(df: DataFrame, products: DataFrame, how: str = "inner",
               key: str = "product_code", dim_key: str = "global_code",
               price_col: str = "retail_price_this_year") -> DataFrame:
    """Join the product dim on differently named keys to pick up the retail price.
    The product dim grows with the catalogue, so no broadcast hint: the planner
    chooses from (runtime) size statistics."""
    p = products.select(F.col(dim_key).alias("__pk"), F.col(price_col).alias(price_col))
    return df.join(p, df[key] == p["__pk"], how).drop("__pk")


def with_portfolio(df: DataFrame, varietals: DataFrame, how: str = "inner") -> DataFrame:
    """Attach the portfolio flag (E5). The key has few values, so attach it to a side that is
    small by then: products before the fact join, or rows at brand grain after the
    aggregate. No hint: the planner broadcasts the dim where its size allows."""
    return df.join(varietals.select("varietal", "in_portfolio"), "varietal", how)


def canonical_keys(df: DataFrame, cols: list[str], suffix: str = "_key") -> DataFrame:
    """Add match keys beside display values."""
    return df.withColumns({c + suffix: match_key(c) for c in cols})


def one_spelling(products: DataFrame, cols: list[str], like: dict[str, DataFrame] | None = None) -> DataFrame:
    """Give values that compare equal (F4) one spelling, so that reports group and join them
    as one, as a server does whose collation ignores case and accents. Meant for products,
    before they meet the facts. The spelling is the one that the dim of ``like`` has for the
    column, else the first in byte order. NULL stays NULL, and no row is lost or doubled.

    Only spellings that change are joined: values are distinct before they move, and no
    hint is given, since their number grows with the catalogue.
    """
    out = products
    for c in cols:
        seen = products.select(F.col(f"`{c}`").alias("__seen"), F.lit(1).alias("__given"))
        if like and c in like:
            seen = seen.unionByName(like[c].select(F.col(f"`{c}`").alias("__seen"), F.lit(0).alias("__given")))
        seen = (seen.where(F.col("__seen").isNotNull()).groupBy("__seen").agg(F.min("__given").alias("__given"))
                .withColumn("__key", match_key("__seen")))
        one = seen.groupBy("__key").agg(F.min(F.struct("__given", "__seen")).alias("__one"))
        changed = (seen.join(one, "__key").where(F.col("__seen") != F.col("__one.__seen"))
                   .select("__seen", F.col("__one.__seen").alias("__put")))
        out = (out.join(changed, F.col(f"`{c}`") == F.col("__seen"), "left")
               .withColumn(c, F.coalesce("__put", F.col(f"`{c}`"))).drop("__seen", "__put"))
    return out


def market_filter(origin: str, exc_varietal: str | None = None, exc_origin: str | None = None,
                  portfolio_col: str | None = None):
    """(portfolio AND origin = home) OR (varietal = exception AND origin = exception)."""
    home = ieq("origin", origin)
    if portfolio_col is not None:
        home = (F.col(portfolio_col) == 1) & home
    if exc_varietal is None:
        return home
    either = home | (ieq("varietal", exc_varietal) & ieq("origin", exc_origin))
    # Implied single-table conjunct: Catalyst does not split a disjunction that spans
    # joined tables, so state the origin-only consequence explicitly; it is pushed to
    # the supplier/origin side and shrinks that side before the fact joins.
    implied = match_key("origin").isin(match_text(origin), match_text(exc_origin))
    return implied & either

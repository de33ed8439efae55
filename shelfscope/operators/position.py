"""Labels derived from market measures: HHI segment and brand archetype."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# HHI segment thresholds and labels, archetype vocabulary.
HHI_COMPETITIVE_MAX = 1500.0
HHI_MODERATE_BELOW = 2500.0
HHI_HIGH_BELOW = 10000.0
HHI_LABELS = ["Unknown", "Competitive", "Moderately concentrated", "Highly concentrated", "Monopoly"]
MOMENTUM_LABELS = ["Expanding", "Contracting", "Steady"]
POSITION_LABELS = ["Leader", "Core", "Challenger", "Niche", "Pipeline"]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hhi_segment(hhi) -> Column:
    """J9 on the rounded HHI."""
    h = _c(hhi)
    return (F.when(h.isNull(), "Unknown")
             .when(h <= HHI_COMPETITIVE_MAX, "Competitive")
             .when(h < HHI_MODERATE_BELOW, "Moderately concentrated")
             .when(h < HHI_HIGH_BELOW, "Highly concentrated")
             .otherwise("Monopoly"))


def _flat(yoy, growth) -> Column:
    return (_c(yoy) == 0) & (_c(growth) == 0)


def momentum(yoy, market_yoy, growth, flat_value: str | None = None) -> Column:
    """Expanding / Contracting / Steady; a brand flat on both measures gets
    ``flat_value`` ('' in the combined label, NULL in the standalone column)."""
    y, m, g = _c(yoy), _c(market_yoy), _c(growth)
    flat = F.lit(flat_value) if flat_value is not None else F.lit(None).cast("string")
    return (F.when((y > m) & (g > 0), "Expanding")
             .when((y < m) & (g < 0), "Contracting")
             .when(_flat(y, g), flat)
             .otherwise("Steady"))


def position(rank, tier) -> Column:
    """Rank 1-2 Leader, else by tier; absent brand (rank/tier 0) -> Pipeline."""
    r, t = _c(rank), _c(tier)
    return (F.when((r == 1) | (r == 2), "Leader")
             .when(t == 1, "Core").when(t == 2, "Challenger").when(t == 3, "Niche")
             .otherwise("Pipeline"))


def archetype(yoy, market_yoy, growth, rank, tier) -> Column:
    """Momentum + separator + position; the separator is dropped when the
    brand is flat on both measures (so the label is just the position)."""
    sep = F.when(_flat(yoy, growth), "").otherwise(" ")
    return F.concat(momentum(yoy, market_yoy, growth, flat_value=""), sep, position(rank, tier))

"""Report parameters (the reference hard-codes these as batch variables)."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class MarketParams:
    """Parameters shared by the market reports.

    ``origin`` is the home origin; ``exception_varietal``/``exception_origin`` is the
    one (varietal, origin) pair admitted besides it; ``focal_brand`` is the brand the
    reports benchmark. Comparisons on origin and brand are case-insensitive.
    """

    origin: str = "AMERICA"
    exception_varietal: str = "PROMO"
    exception_origin: str = "EUROPE"
    focal_brand: str = "Brand#7"
    last_year: str = "LRY"
    this_year: str = "TRY"
    tier1_threshold: float = 50.0
    tier2_threshold: float = 80.0
    cum_share_cutoff: float = 95.0
    unit_size: int | None = None          # format filter (None = all formats)
    varietal: str | None = None           # varietal filter for the top-N report
    top_n: int = 3
    extra: dict = field(default_factory=dict)

    def with_(self, **kw) -> "MarketParams":
        return replace(self, **kw)


# Proxy-market defaults used by the registered queries.
DEFAULT = MarketParams()

"""Numeric expressions: guarded ratios, rounding, coercion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepts what pandas.to_numeric accepts for plain decimal / scientific text (trap T6);
# Spark's try_cast alone would accept '12d' and similar suffixes.
NUMERIC_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num, den, scale: float = 1.0) -> Column:
    """``num * scale / NULLIF(den, 0)`` evaluated in double.

    Inputs are exact decimal sums; the division is done in IEEE double so results are
    bit-identical across engines. Zero or NULL denominators give NULL, never an error
    (ANSI mode raises on division by zero, trap T8).
    """
    n = _c(num).cast("double")
    if scale != 1.0:
        n = n * F.lit(float(scale))
    return n / F.nullif(_c(den).cast("double"), F.lit(0.0))


def ratio0(num, den, scale: float = 1.0) -> Column:
    """``COALESCE(ratio, 0)`` -- the reference's guarded-share idiom."""
    return F.coalesce(ratio(num, den, scale), F.lit(0.0))


def yoy(ty, ly, scale: float = 100.0) -> Column:
    """Year-on-year change; absent year or zero base -> 0 (trap T11)."""
    return ratio0(_c(ty) - _c(ly), ly, scale)


def round_half_away(c, digits: int) -> Column:
    """Round half away from zero at ``digits`` decimals on the binary value.

    Spark's ``round(double, d)`` first renders the shortest decimal string; this form
    scales then rounds at scale 0, which agrees with SQL engines that round the
    binary value.
    """
    f = float(10 ** digits)
    return F.round(_c(c) * F.lit(f), 0) / F.lit(f)


def dec2(c) -> Column:
    """``CAST(x AS DECIMAL(p,2))`` semantics on a double ratio, kept as double."""
    return round_half_away(c, 2)


def percent2(num, den) -> Column:
    """``CAST(num * 100 / NULLIF(den, 0) AS DECIMAL(p, 2))`` of exact decimals, half away
    from zero, as a double; NULL or zero denominators give 0.

    The quotient in hundredths of a percent is an integral division of decimals, so a
    tie such as 1.005 % is decided exactly (1.01), not on its binary neighbour.
    """
    n, d = _c(num), _c(den)
    # a plain 0 / NULL denominator must not reach the division (ANSI mode raises)
    safe = F.nullif(F.abs(d), F.lit(0).cast("decimal(1,0)"))
    whole = F.call_function("div", F.abs(n) * F.lit(20000).cast("decimal(5,0)") + safe, safe * F.lit(2).cast("decimal(1,0)"))
    sign = F.signum(n.cast("double")) * F.signum(d.cast("double"))
    return F.coalesce(whole.cast("double") / F.lit(100.0) * sign, F.lit(0.0))


def yoy2(ty, ly) -> Column:
    """Year-on-year change in percent, two exact decimals (0 without a base)."""
    return percent2(_c(ty) - _c(ly), ly)


def dec0(c) -> Column:
    return F.round(_c(c), 0)


def round2(c) -> Column:
    """NumPy ``round(x, 2)``: scale by 100, round half to even, unscale (trap T5)."""
    return F.rint(_c(c) * F.lit(100.0)) / F.lit(100.0)


def coerce_numeric(c) -> Column:
    """``pd.to_numeric(errors='coerce').fillna(0).round(2)`` on text or numbers."""
    s = F.trim(_c(c).cast("string"))
    ok = s.rlike(NUMERIC_TEXT)
    val = F.when(ok, s.try_cast("double"))
    return round2(F.coalesce(val, F.lit(0.0)))


def row_total(cols) -> Column:
    """Row-wise sum treating NULL as 0 (pandas ``sum(axis=1)`` skips NaN), summed
    left to right."""
    expr = F.lit(0.0)
    for c in cols:
        expr = expr + F.coalesce(_c(c).cast("double"), F.lit(0.0))
    return expr

"""Period labels for the two retail calendars.

* monthly:  ``YYYYMmm``  (12 per year)
* fiscal:   ``YYYYPnn``  (13 four-week periods, fiscal year starting 1 April;
  the label year is the fiscal year's start year, the 13th period absorbs the
  remaining day or two)

A rolling year is the 12 (monthly) or 13 (fiscal) labels ending at an anchor label.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed calendar values.
FISCAL_START_MONTH = 4
FISCAL_START_DAY = 1
FISCAL_PERIOD_DAYS = 28
FISCAL_PERIODS = 13
MONTHS = 12


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_label(d) -> Column:
    return F.date_format(_c(d), "yyyy'M'MM")


def fiscal_year(d, start_month: int = FISCAL_START_MONTH, start_day: int = FISCAL_START_DAY) -> Column:
    d = F.to_date(_c(d))
    y = F.year(d)
    start = F.make_date(y, F.lit(start_month), F.lit(start_day))
    return F.when(d < start, y - 1).otherwise(y)


def fiscal_period(d, start_month: int = FISCAL_START_MONTH, start_day: int = FISCAL_START_DAY) -> Column:
    """13-period fiscal label of a date: ``least(13, floor(days_since_start / 28) + 1)``."""
    d = F.to_date(_c(d))
    fy = fiscal_year(d, start_month, start_day)
    start = F.make_date(fy, F.lit(start_month), F.lit(start_day))
    seq = F.least(F.lit(FISCAL_PERIODS), F.floor(F.datediff(d, start) / F.lit(FISCAL_PERIOD_DAYS)).cast("int") + 1)
    return F.format_string("%04dP%02d", fy, seq)


def label_year(label) -> Column:
    return F.substring(_c(label), 1, 4).cast("int")


def label_kind(label) -> Column:
    return F.substring(_c(label), 5, 1)


def label_seq(label) -> Column:
    return F.substring(_c(label), 6, 2).cast("int")


def label_ordinal(label) -> Column:
    """Position of a label on its own calendar's axis (periods since year 0)."""
    per_year = F.when(label_kind(label) == "P", F.lit(FISCAL_PERIODS)).otherwise(F.lit(MONTHS))
    return label_year(label) * per_year + label_seq(label)


def python_labels(kind: str, anchor: str, count: int) -> list[str]:
    """The ``count`` labels ending at ``anchor`` (inclusive), oldest first. Driver-side,
    used only to turn report parameters into literal period lists."""
    per_year = FISCAL_PERIODS if kind == "P" else MONTHS
    y, s = int(anchor[:4]), int(anchor[5:])
    ords = [y * per_year + s - i for i in range(count)][::-1]
    out = []
    for o in ords:
        yy, ss = divmod(o, per_year)
        if ss == 0:
            yy, ss = yy - 1, per_year
        out.append(f"{yy:04d}{kind}{ss:02d}")
    return out


def python_label_bounds(labels: list[str]):
    """[start, end) dates covered by a contiguous label list (driver-side, from
    parameters only): used to push a date range to the fact scan."""
    import datetime as dt

    def start(label: str) -> dt.date:
        y, k, s = int(label[:4]), label[4], int(label[5:])
        if k == "M":
            return dt.date(y, s, 1)
        return dt.date(y, FISCAL_START_MONTH, FISCAL_START_DAY) + dt.timedelta(days=FISCAL_PERIOD_DAYS * (s - 1))

    last = labels[-1]
    y, k, s = int(last[:4]), last[4], int(last[5:])
    if k == "M":
        end = dt.date(y + (s == 12), s % 12 + 1, 1)
    elif s == FISCAL_PERIODS:
        end = dt.date(y + 1, FISCAL_START_MONTH, FISCAL_START_DAY)
    else:
        end = start(last) + dt.timedelta(days=FISCAL_PERIOD_DAYS)
    return start(labels[0]), end


def label_start(label) -> Column:
    """First day of a label of either calendar."""
    y, s = label_year(label), label_seq(label)
    fiscal = F.date_add(F.make_date(y, F.lit(FISCAL_START_MONTH), F.lit(FISCAL_START_DAY)), (s - 1) * FISCAL_PERIOD_DAYS)
    return F.when(label_kind(label) == "P", fiscal).otherwise(F.make_date(y, F.least(s, F.lit(MONTHS)), F.lit(1)))


def label_end(label) -> Column:
    """Day after the last one of a label of either calendar; the last fiscal period ends with its year."""
    y, s = label_year(label), label_seq(label)
    fiscal = F.when(s >= FISCAL_PERIODS, F.make_date(y + 1, F.lit(FISCAL_START_MONTH), F.lit(FISCAL_START_DAY))).otherwise(
        F.date_add(label_start(label), FISCAL_PERIOD_DAYS))
    return F.when(label_kind(label) == "P", fiscal).otherwise(F.add_months(label_start(label), 1))


def ordinal_label(ordinal: Column, kind: str) -> Column:
    """The label at a position of a calendar's axis (the inverse of ``label_ordinal``)."""
    n = F.lit(FISCAL_PERIODS if kind == "P" else MONTHS)
    return F.format_string(f"%04d{kind}%02d", F.floor((ordinal - 1) / n).cast("int"), (F.pmod(ordinal - 1, n) + 1).cast("int"))


def label_of(d, kind: str) -> Column:
    """The label of a date on the calendar ``kind``."""
    return fiscal_period(d) if kind == "P" else month_label(d)

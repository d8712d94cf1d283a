"""Calendar expressions and pushdown-friendly period predicates."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, functions as F


def as_date(value: str | dt.date) -> dt.date:
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(value)


def whole_days(c: Column, desde: str | dt.date | None, hasta: str | dt.date | None) -> Column:
    """``desde`` 00:00 up to, but excluding, midnight after ``hasta``; either may be None.

    Half-open bounds on the bare column reach the Parquet scan and keep the last
    fraction of a second of ``hasta``.
    """
    keep = F.lit(True)
    if desde is not None:
        keep = keep & (c >= F.lit(as_date(desde)))
    if hasta is not None:
        keep = keep & (c < F.lit(as_date(hasta) + dt.timedelta(days=1)))
    return keep


def instant(value: str | dt.datetime) -> Column:
    """A zone-less timestamp literal."""
    text = value.isoformat(sep=" ") if isinstance(value, dt.datetime) else value
    return F.lit(text).cast("timestamp_ntz")


def year_in(c: Column, years: Iterable[int]) -> Column:
    """``year(c) IN years`` as bounds on the bare column.

    ``year(c)`` never reaches the Parquet scan; the covering range does, so row groups
    outside the years are skipped. The exact test stays only where years are left out.
    """
    years = sorted(set(years))
    inside = (c >= F.lit(dt.date(years[0], 1, 1))) & (c < F.lit(dt.date(years[-1] + 1, 1, 1)))
    if len(years) <= years[-1] - years[0]:
        inside = inside & F.year(c).isin(*years)
    return inside


def month_label(c: Column) -> Column:
    """``YYYY-MM``."""
    return F.date_format(c, "yyyy-MM")


def seconds(n: int) -> Column:
    return F.make_dt_interval(secs=F.lit(n))

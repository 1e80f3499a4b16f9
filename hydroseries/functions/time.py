"""Scalar time functions (C1-C6, C8, C10, D1, D2) as native column expressions.

All timestamps are ``TIMESTAMP_NTZ`` holding UTC wall time; the session time
zone is UTC (see ``hydroseries.session``), so casting to ``TIMESTAMP`` and
back is exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from hydroseries import config as C


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_epoch(ts) -> Column:
    """Timestamp -> whole epoch seconds (UTC)."""
    return F.unix_seconds(_c(ts).cast("timestamp"))


def from_epoch(seconds) -> Column:
    """C4: epoch seconds -> UTC ``TIMESTAMP_NTZ``."""
    return F.timestamp_seconds(_c(seconds)).cast("timestamp_ntz")


def hour_index(ts) -> Column:
    """Whole hours since the epoch; the key of the dense hourly grid."""
    return F.floor(to_epoch(ts) / F.lit(3600)).cast("bigint")


def from_hour_index(h) -> Column:
    return from_epoch(_c(h) * F.lit(3600))


def floor_hour(ts) -> Column:
    """Truncate to the hour, keeping ``TIMESTAMP_NTZ``."""
    return F.date_trunc("hour", _c(ts)).cast("timestamp_ntz")


def to_local(ts, tz: str) -> Column:
    """UTC wall time -> local wall time of zone ``tz`` (both NTZ)."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), _c(ts).cast("timestamp_ntz"))


def to_utc(ts, tz: str) -> Column:
    """Local wall time of ``tz`` -> UTC wall time (both NTZ)."""
    return F.convert_timezone(F.lit(tz), F.lit("UTC"), _c(ts).cast("timestamp_ntz"))


def normalize_time(df, tz: str, col: str = "ts", naive_is_local: bool = True):
    """C5 on a DataFrame: naive local wall time of ``tz`` -> UTC wall time
    (``naive_is_local``), keeping ``TIMESTAMP_NTZ``; instants (``TIMESTAMP``)
    are cast directly (session zone UTC)."""
    from pyspark.sql import types as TT
    dt_ = df.schema[col].dataType
    if isinstance(dt_, TT.TimestampType):
        return df.withColumn(col, F.col(col).cast("timestamp_ntz"))
    return df.withColumn(col, to_utc(col, tz) if naive_is_local else F.col(col).cast("timestamp_ntz"))


def parse_utc(text, fmt: str | None = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Parse timestamp text that is UTC (``fmt`` None: any ISO form)."""
    return F.to_timestamp_ntz(_c(text)) if fmt is None else F.to_timestamp_ntz(_c(text), F.lit(fmt))


def local_hour(ts, tz: str) -> Column:
    """The instant (UTC) at which the local hour of ``ts`` began.

    Hours of zones with a part-hour offset begin off the UTC hour; the two hours of one name
    at the end of summer time stay apart, since both are instants.  Holds for zones whose clock
    changes are whole hours."""
    local = to_local(ts, tz)
    past = F.unix_micros(local.cast("timestamp")) - F.unix_micros(F.date_trunc("hour", local).cast("timestamp"))
    return F.timestamp_micros(F.unix_micros(_c(ts).cast("timestamp")) - past).cast("timestamp_ntz")


def calendar_columns(ts, tz: str) -> dict[str, Column]:
    """Local calendar fields; Monday = 0, ISO week, weekend = Sat/Sun."""
    lt = to_local(ts, tz)
    dow = F.weekday(lt)
    return {
        "hour_of_day": F.hour(lt),
        "day_of_week": dow,
        "month": F.month(lt),
        "day_of_year": F.dayofyear(lt),
        "week_of_year": F.weekofyear(lt),
        "is_weekend": (dow >= 5).cast("int"),
        "quarter": F.quarter(lt),
    }


def lunar_phase(ts) -> Column:
    """Phase in [0, 8): share of the synodic month since the reference
    new moon, times eight.  ``ts`` is a UTC instant."""
    month_s = C.SYNODIC_MONTH_DAYS * 24 * 3600
    seconds = F.unix_micros(_c(ts).cast("timestamp")) / F.lit(1e6)
    diff = seconds - F.lit(float(C.LUNAR_REFERENCE_EPOCH_S))
    return F.pmod(diff, F.lit(month_s)) / F.lit(month_s) * F.lit(float(C.LUNAR_PHASES))


def cyclic(x, period: float) -> tuple[Column, Column]:
    """(sin, cos) encoding of a periodic field."""
    a = _c(x).cast("double") * F.lit(2 * math.pi / period)
    return F.sin(a), F.cos(a)


def cyclic_columns(ts, tz: str) -> dict[str, Column]:
    lt = to_local(ts, tz)
    out = {}
    for name, x, period in (("hour", F.hour(lt), 24.0),
                            ("dow", F.weekday(lt), 7.0),
                            ("month", F.month(lt), 12.0)):
        s, c = cyclic(x, period)
        out[f"{name}_sin"] = s
        out[f"{name}_cos"] = c
    return out


def harmonic(t, period: float, amplitude: float, offset: float) -> Column:
    """``amplitude * sin(2 pi t / period) + offset``."""
    return F.sin(_c(t).cast("double") * F.lit(2 * math.pi / period)) * F.lit(amplitude) + F.lit(offset)


def is_rainy_season(ts, tz: str | None = None) -> Column:
    """Month within the rainy season (inclusive)."""
    t = to_local(ts, tz) if tz else _c(ts)
    lo, hi = C.RAINY_SEASON_MONTHS
    return F.month(t).between(lo, hi)


def is_day(ts, tz: str) -> Column:
    """Local hour between 6 and 17."""
    return F.hour(to_local(ts, tz)).between(6, 17)

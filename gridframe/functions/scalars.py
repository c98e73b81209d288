"""Column -> Column helpers (mapping, parsing, dates, time zones, features).

Everything here is a built-in Spark expression; nothing is evaluated row by row
in Python.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- mapping ----

def literal_map(mapping: Mapping) -> Column:
    """A literal MAP column built from a Python dict (folded to a constant)."""
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])


def map_replace(c, mapping: Mapping) -> Column:
    """``Series.replace(dict)``: mapped values are replaced, others are kept."""
    c = _c(c)
    return F.coalesce(F.try_element_at(literal_map(mapping), c), c)


def map_lookup(c, mapping: Mapping) -> Column:
    """``Series.map(dict)``: unmapped values (and nulls) become NULL."""
    return F.try_element_at(literal_map(mapping), _c(c))


# ---------------------------------------------------------------- strings ----

def split_part(c, sep: str, index: int) -> Column:
    """0-based piece of ``c`` split on a literal separator; NULL if absent."""
    return F.try_element_at(F.split(_c(c), _regex_quote(sep)), F.lit(index + 1))


def _regex_quote(s: str) -> str:
    return "".join("\\" + ch if ch in r".^$*+?{}[]\|()" else ch for ch in s)


def substring0(c, start: int, length: int) -> Column:
    """Python-style slice ``c[start:start+length]``."""
    return F.substring(_c(c), start + 1, length)


def num_coerce(c) -> Column:
    """``pd.to_numeric(errors='coerce')``: unparsable text becomes NULL."""
    return _c(c).try_cast("double")


def nan_to_null(c) -> Column:
    return F.nanvl(_c(c), F.lit(None).cast("double"))


# ------------------------------------------------------------ timestamps ----

_TIME_RE = r"^(\d{1,2})(?::(\d{2}))?(?::(\d{2}(?:\.\d+)?))?$"


def ts_from_date_time(date_col, time_col) -> Column:
    """DATE + time-of-day text (``HH:mm:ss``, ``HH:mm`` or ``HH``) ->
    TIMESTAMP_NTZ; malformed text gives NULL.  Built from parts with
    ``try_make_timestamp_ntz`` so no step goes through the session time zone
    (parsing to a zoned timestamp would move wall times inside that zone's
    DST gap)."""
    t = F.trim(_c(time_col))
    part = lambda i: F.regexp_extract(t, _TIME_RE, i)
    # text that doesn't match has the empty hour, and NULL parts make a NULL
    h = F.nullif(part(1), F.lit("")).cast("int")
    mi = F.coalesce(F.nullif(part(2), F.lit("")), F.lit("0")).cast("int")
    sec = F.coalesce(F.nullif(part(3), F.lit("")), F.lit("0")).cast("decimal(16,6)")
    d = _c(date_col).cast("date")
    return F.try_make_timestamp_ntz(F.year(d), F.month(d), F.dayofmonth(d), h, mi, sec)


def ts_from_parts(y, m, d) -> Column:
    """(year, month, day) -> DATE; invalid combinations give NULL."""
    return F.try_make_timestamp_ntz(_c(y), _c(m), _c(d), F.lit(0), F.lit(0), F.lit(0)).cast("date")


def ts_plus_seconds(ts, seconds) -> Column:
    return _c(ts) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), _c(seconds).cast("decimal(18,6)"))


def bound(value, use: Callable[[Column], Column]) -> Column:
    """``use(x)`` with ``x`` evaluated once, however often ``use`` names it: a
    column that is used several times is repeated in the plan at each use, and
    nested uses multiply."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def localize(wall, zone: str, ambiguous: str = "null", nonexistent: str = "null") -> Column:
    """Interpret a wall-clock TIMESTAMP_NTZ in ``zone``; return the instant as
    a UTC wall clock TIMESTAMP_NTZ.

    ``ambiguous='null'`` reproduces ``tz_localize(ambiguous='NaT')``: the
    repeated hour of a DST fall-back becomes NULL.  Spark on its own silently
    picks one offset, so it is detected explicitly: a wall time is ambiguous when
    the instant one hour later or earlier maps back to the same wall time.
    ``nonexistent='null'`` turns wall times inside a spring-forward gap into
    NULL (the source raised an error there); ``'shift'`` keeps Spark's shift.

    Everything is TIMESTAMP_NTZ arithmetic with ``convert_timezone``, so the
    result does not depend on the session time zone.
    """
    z, utc_z = F.lit(zone), F.lit("UTC")
    hour = F.expr("INTERVAL 1 HOUR")

    def guarded(wall: Column, utc: Column) -> Column:
        is_gap = F.convert_timezone(utc_z, z, utc) != wall
        is_amb = (F.convert_timezone(utc_z, z, utc + hour) == wall) | \
                 (F.convert_timezone(utc_z, z, utc - hour) == wall)
        out = utc
        if ambiguous == "null":
            out = F.when(is_amb, F.lit(None)).otherwise(out)
        if nonexistent == "null":
            out = F.when(is_gap, F.lit(None)).otherwise(out)
        return out

    return bound(_c(wall).cast("timestamp_ntz"),
                 lambda w: bound(F.convert_timezone(z, utc_z, w), lambda u: guarded(w, u)))


def utc_to_zone(utc_wall, zone: str) -> Column:
    """UTC wall clock (TIMESTAMP_NTZ) -> wall clock in ``zone`` (TIMESTAMP_NTZ)."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), _c(utc_wall).cast("timestamp_ntz"))


def tz_convert(wall, from_zone: str, to_zone: str, **kw) -> Column:
    """Wall clock in ``from_zone`` -> wall clock in ``to_zone`` with DST guards."""
    return utc_to_zone(localize(wall, from_zone, **kw), to_zone)


# ------------------------------------------------------------- date parts ----

def weekday0(d) -> Column:
    """Monday = 0 ... Sunday = 6 (pandas ``dt.weekday``)."""
    return F.weekday(_c(d))


def day_name(d) -> Column:
    return F.date_format(_c(d), "EEEE")


def month_name(d) -> Column:
    return F.date_format(_c(d), "MMMM")


def month_start(d) -> Column:
    """``to_period('M')`` as the first day of the month (DATE)."""
    return F.trunc(_c(d).cast("date"), "MM")


def year_month_text(d) -> Column:
    return F.date_format(_c(d), "yyyy-MM")


def previous_friday(d) -> Column:
    """Same day for Mon-Fri; the Friday before for Saturday and Sunday."""
    d = _c(d).cast("date")
    return F.when(weekday0(d) >= 5, F.date_sub(d, weekday0(d) - 4)).otherwise(d)


def epoch_seconds(ts) -> Column:
    """Whole seconds since 1970-01-01 of a wall clock (floor), like
    ``(t - epoch) // 1s``; plain date arithmetic, independent of the session
    time zone."""
    t = _c(ts).cast("timestamp_ntz")
    days = F.datediff(F.to_date(t), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.floor(F.second(t))


def weekend_flag(d) -> Column:
    return F.when(weekday0(d) >= 5, F.lit(1)).otherwise(F.lit(0))


def cyclic(c, period: float) -> tuple[Column, Column]:
    """(sin, cos) of ``2*pi*c/period``."""
    ang = F.lit(2 * math.pi) * _c(c).cast("double") / F.lit(float(period))
    return F.sin(ang), F.cos(ang)


def ratio(a, b) -> Column:
    """a / b with NULL for a zero denominator (no ANSI error)."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def safe_name(name: str) -> str:
    """Turn a label such as ``SE/CW`` or ``MIDDLE EAST`` into a column-safe token."""
    out = "".join(ch if ch.isalnum() else "_" for ch in name)
    while "__" in out:
        out = out.replace("__", "_")
    return out.strip("_")

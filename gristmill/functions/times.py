"""Time expressions: parsing, ages, backoff, quiet hours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats tried in turn.
FORMATS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ssXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")


def parsed(c: Column, now: Column | None = None) -> Column:
    """A timestamp from any of FORMATS, RFC 1123, or epoch seconds or milliseconds; null if none fits or it lies over a day ahead of now."""
    epoch = c.try_cast("long")
    digits = c.rlike(r"^\d{10}$|^\d{13}$")
    rfc = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(c, r"^[A-Za-z]{3},\s*", ""), " GMT$", " +0000"), F.lit("dd MMM yyyy HH:mm:ss XX"))
    text = F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in FORMATS), rfc)
    out = F.when(digits, F.when(F.length(c) == 13, F.timestamp_millis(epoch)).otherwise(F.timestamp_seconds(epoch))).otherwise(text)
    return out if now is None else F.when(out <= F.timestamp_add("DAY", F.lit(1), now), out)


def whole_days(later: Column, earlier: Column) -> Column:
    """Whole days of 24 hours between, 0 at least."""
    return F.greatest(F.lit(0).cast("long"), F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / 86_400_000_000))


def iso_week(c: Column) -> Column:
    return F.to_date(F.date_trunc("week", c))


def backoff_hours(failures: Column, first: int = 3, base: int = 6, cap: int = 24) -> Column:
    """0 below `first` failures, then base doubled for each further one, capped."""
    return F.when(failures < first, F.lit(0.0)).otherwise(F.least(F.lit(float(cap)), base * F.pow(F.lit(2.0), F.least(failures - first, F.lit(20)))))


def in_quiet_hours(at: Column, zone: Column, start: Column, end: Column) -> Column:
    """Whether the local hour lies in [start, end), which may wrap over midnight; an empty window holds nothing."""
    h = F.hour(F.from_utc_timestamp(at, zone))
    return F.when(start == end, F.lit(False)).when(start < end, (h >= start) & (h < end)).otherwise((h >= start) | (h < end))


def crosses(at: Column, days: list[int], since: Column, until: Column) -> Column:
    """Whether at plus any of the ages falls in (since, until]."""
    return F.exists(F.array(*(F.timestamp_add("DAY", F.lit(d), at) for d in days)), lambda t: (t > since) & (t <= until))


def digest_due(now: Column, zone: Column, hour: Column, last: Column) -> Column:
    """Whether the local hour has come and nothing went out on this local day yet."""
    local = F.from_utc_timestamp(now, zone)
    return (F.hour(local) >= hour) & (last.isNull() | (F.to_date(F.from_utc_timestamp(last, zone)) < F.to_date(local)))

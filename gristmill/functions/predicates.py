"""Predicates that every rollup shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The reasons that are real closures.
REAL_CLOSURES = ("employer_closed", "feed_removed", "probe_expired", "unseen")


def exists_from(posted: str = "posted", created: str = "created") -> Column:
    """When a posting began to exist: the earlier of the two, nulls skipped."""
    return F.least(F.col(posted), F.col(created))


def open_at(day: Column, posted: str = "posted", created: str = "created", closed: str = "closed") -> Column:
    """Open on a day: exists by then, and not closed or closed later (the closing day itself is not open)."""
    return (exists_from(posted, created) <= day) & (F.col(closed).isNull() | (F.col(closed) > day))


def listed(closed: str = "closed", duplicate_of: str = "duplicate_of", private: str = "is_private") -> Column:
    return F.col(closed).isNull() & F.col(duplicate_of).isNull() & ~F.coalesce(F.col(private), F.lit(False))


def canonical(duplicate_of: str = "duplicate_of", private: str = "is_private") -> Column:
    return F.col(duplicate_of).isNull() & ~F.coalesce(F.col(private), F.lit(False))


def really_closed(reason: str = "reason", closed: str = "closed") -> Column:
    return F.col(closed).isNotNull() & F.col(reason).isin(*REAL_CLOSURES)


def withheld(body: Column, last_seen: Column, source: Column, windows: dict[str, int], default_days: int, now: Column) -> Column:
    """First reason to withhold a posting (no body, then unseen past its source's window), null if none."""
    days = F.lit(default_days)
    for name, n in windows.items():
        days = F.when(source == name, F.lit(n)).otherwise(days)
    return F.when(body.isNull() | (F.trim(body) == ""), F.lit("no_body")).when(F.date_diff(now, last_seen) > days, F.lit("unseen"))

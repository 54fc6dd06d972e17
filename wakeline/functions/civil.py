"""Civil days and dayparts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def civil_day_bounds(date: Column, zone: str) -> tuple[Column, Column]:
    """UTC instants (without zone) of a local day's midnights; 23 or 25 hours apart on change days."""
    start = F.to_utc_timestamp(date.cast("timestamp"), zone)
    end = F.to_utc_timestamp(F.date_add(date, 1).cast("timestamp"), zone)
    return start.cast("timestamp_ntz"), end.cast("timestamp_ntz")


def daypart(ts: Column, zone: str, bins: dict[str, tuple[int, int]]) -> Column:
    """The label of the local hour's bin [from, to), else null. Bins must not overlap."""
    hours = [h for a, b in bins.values() for h in range(a, b)]
    if len(hours) != len(set(hours)) or any(not 0 <= a < b <= 24 for a, b in bins.values()):
        raise ValueError("dayparts must be hour bins that don't overlap")
    hour = F.hour(F.from_utc_timestamp(ts, zone))
    return F.coalesce(*[F.when((hour >= a) & (hour < b), F.lit(label)) for label, (a, b) in bins.items()], F.lit(None).cast("string"))

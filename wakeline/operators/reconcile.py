"""Scope, duplicates and conflicts of reports, and the state that is carried to the next window."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.parsing import valid_mmsi


@dataclass(frozen=True)
class SpatialFilter:
    """A longitude-latitude rectangle with a buffer in degrees; no antimeridian."""

    domain_reference: str
    west: float
    south: float
    east: float
    north: float
    buffer_degrees: float

    def __post_init__(self) -> None:
        if not self.domain_reference:
            raise ValueError("a domain reference is required")
        if not (-180 <= self.west < self.east <= 180 and -90 <= self.south < self.north <= 90):
            raise ValueError("bounds must increase and be valid degrees")
        if not 0 <= self.buffer_degrees <= 10:
            raise ValueError("the buffer must be 0 to 10 degrees")

    def contains(self, lon: Column, lat: Column) -> Column:
        b = self.buffer_degrees
        return lon.between(self.west - b, self.east + b) & lat.between(self.south - b, self.north + b)


@dataclass(frozen=True)
class TimeWindow:
    """Core and halo, half-open; the halo holds the core."""

    core_start: datetime
    core_end: datetime
    halo_start: datetime
    halo_end: datetime

    def __post_init__(self) -> None:
        if not self.halo_start <= self.core_start < self.core_end <= self.halo_end:
            raise ValueError("the halo must hold a positive core")


def with_scope(parsed: DataFrame, spatial: SpatialFilter, window: TimeWindow) -> DataFrame:
    """parsed rows (with declared_start, declared_end) with reasons, outcome (rejected, candidate, filtered) and scope."""
    ts = F.col("timestamp")
    declared = (ts >= F.col("declared_start")) & (ts < F.col("declared_end"))
    reasons = F.when(
        (F.size("reasons") == 0) & ~declared, F.array(F.lit("outside_declared_source_window"))
    ).otherwise(F.col("reasons"))
    rows = parsed.withColumn("reasons", reasons)
    rejected = F.size("reasons") > 0
    core = (ts >= F.lit(window.core_start)) & (ts < F.lit(window.core_end))
    inside = (ts >= F.lit(window.halo_start)) & (ts < F.lit(window.halo_end)) & spatial.contains(F.col("longitude"), F.col("latitude"))
    return rows.select(
        "*",
        F.when(rejected, F.lit("rejected")).when(inside, F.lit("candidate")).otherwise(F.lit("filtered")).alias("outcome"),
        F.when(rejected, F.lit("unknown"))
        .when(~inside, F.lit("outside"))
        .when(core, F.lit("core"))
        .otherwise(F.lit("halo"))
        .alias("scope"),
    ).withColumn("reasons", F.when(F.col("outcome") == "filtered", F.array(F.lit("outside_candidate_filter"))).otherwise(F.col("reasons")))


def simultaneous(rows: DataFrame) -> DataFrame:
    """rows with variants (distinct signatures) and keeper (smallest key) of each vessel and instant.

    Only candidate and filtered rows take part; rows without identity or time have none. min and max tell
    whether signatures differ without gathering them. Rows without a time are no group: _apart deals them out.
    """
    rows = rows.withColumn("_apart", F.when(F.col("timestamp").isNull(), F.xxhash64("record_key")).otherwise(F.lit(0)))
    w = W.partitionBy("mmsi", "timestamp", "_apart")
    eligible = F.col("outcome").isin("candidate", "filtered")
    return rows.select(
        "*",
        (F.min(F.when(eligible, F.col("signature"))).over(w) != F.max(F.when(eligible, F.col("signature"))).over(w)).alias("differs"),
        F.min(F.when(eligible, F.col("record_key"))).over(w).alias("keeper"),
    )


def reconciled(rows: DataFrame, carried: DataFrame | None = None) -> DataFrame:
    """Candidate and filtered rows to accepted, duplicate, filtered or rejected.

    Conflicting reports of one vessel and instant are all rejected, filtered ones too; of agreeing candidates
    the one with the smallest key is accepted. carried(mmsi, timestamp, signature, record_key) is last time's
    endpoint: a report at its instant that differs is in conflict with it (carried_conflict).
    """
    grouped = simultaneous(rows)
    if carried is None:
        grouped = grouped.withColumn("carried_conflict", F.lit(None).cast("string"))
    else:
        c = carried.select("mmsi", "timestamp", F.lit(0).cast("long").alias("_apart"), F.col("signature").alias("_own"), F.col("record_key").alias("_key"))
        grouped = grouped.join(c, ["mmsi", "timestamp", "_apart"], "left")
        grouped = grouped.withColumn(
            "carried_conflict", F.when(F.col("signature") != F.col("_own"), F.col("_key"))
        ).drop("_own", "_key")
    eligible = F.col("outcome").isin("candidate", "filtered")
    conflict = eligible & (F.coalesce("differs", F.lit(False)) | F.col("carried_conflict").isNotNull())
    more = F.array_compact(
        F.array(
            F.lit("simultaneous_identity_position_conflict"),
            F.concat(F.lit("carried_endpoint_conflict:"), F.col("carried_conflict")),
        )
    )
    outcome = (
        F.when(conflict, F.lit("rejected"))
        .when(F.col("outcome") != "candidate", F.col("outcome"))
        .when(F.col("record_key") == F.col("keeper"), F.lit("accepted"))
        .otherwise(F.lit("duplicate"))
    )
    return grouped.withColumns(
        {"reasons": F.when(conflict, F.concat("reasons", more)).otherwise(F.col("reasons")), "outcome": outcome}
    ).drop("differs", "keeper", "_apart")


def dealt(audit: DataFrame) -> DataFrame:
    """audit by vessel and time in each partition; rows that belong to no vessel's track are spread by their keys."""
    tracked = F.coalesce(valid_mmsi(F.col("mmsi")) & F.col("timestamp").isNotNull(), F.lit(False))
    rows = audit.repartition(F.col("mmsi"), F.when(~tracked, F.xxhash64("record_key")))
    return rows.sortWithinPartitions("mmsi", "timestamp", "record_key")


def carried_state(audit: DataFrame, core_end: datetime | Column, prior: DataFrame | None = None) -> DataFrame:
    """(mmsi, point, barrier_seen) after a window, for every vessel that it or prior(mmsi, point, barrier_seen) has.

    point: the latest accepted report before core_end, newer than the carried one; a carried one in conflict
    is retired. barrier_seen: any rejection or conflict so far.
    """
    end = core_end if isinstance(core_end, Column) else F.lit(core_end)
    # By name, so that states of different runs have one type.
    row = F.struct(*sorted(c for c in audit.columns if c != "carried_conflict"))
    rows = audit.filter(valid_mmsi(F.col("mmsi"))).select("mmsi", "timestamp", "record_key", "outcome", "carried_conflict", row.alias("row"))
    if prior is None:
        kept = rows.withColumns({"_ts": F.lit(None).cast("timestamp"), "_hit": F.lit(None).cast("string")})
    else:
        known = prior.select("mmsi", F.col("point.timestamp").alias("_ts"))
        kept = rows.join(known, "mmsi", "left")
        hits = rows.filter("carried_conflict IS NOT NULL").groupBy("mmsi").agg(F.max("record_key").alias("_hit"))
        kept = kept.join(hits, "mmsi", "left")
    ts = F.col("timestamp")
    newer = F.col("_ts").isNull() | (ts > F.col("_ts")) | ((ts == F.col("_ts")) & (F.col("record_key") > F.col("_hit")))
    fresh = (F.col("outcome") == "accepted") & (ts < end) & F.coalesce(newer, F.lit(False))
    seen = kept.groupBy("mmsi").agg(
        F.max_by(F.when(fresh, F.col("row")), F.when(fresh, ts)).alias("newest"),
        F.coalesce(F.bool_or(F.col("outcome") == "rejected"), F.lit(False)).alias("rejected"),
        F.max(F.col("carried_conflict").isNotNull()).alias("conflict"),
    )
    if prior is None:
        return seen.select("mmsi", F.col("newest").alias("point"), (F.col("rejected") | F.col("conflict")).alias("barrier_seen"))
    before = prior.select("mmsi", F.col("point").alias("_point"), F.col("barrier_seen").alias("_barrier"))
    conflict = F.coalesce("conflict", F.lit(False))
    return seen.join(before, "mmsi", "full_outer").select(
        "mmsi",
        F.coalesce("newest", F.when(~conflict, F.col("_point"))).alias("point"),
        (F.coalesce("_barrier", F.lit(False)) | F.coalesce("rejected", F.lit(False)) | conflict).alias("barrier_seen"),
    )


def message_groups(positions: DataFrame) -> DataFrame:
    """(mmsi, timestamp, outcome, messages): reports of one vessel and instant as unique, duplicate or conflict.

    Values are compared as values (-0.0 equals 0.0). messages are the keys, sorted.
    """
    values = F.struct("longitude", "latitude", "sog_knots", "raw_vessel_code", "equipment_class", "imo", "quality_flags")
    return (
        positions.groupBy("mmsi", "timestamp")
        .agg(
            F.array_sort(F.collect_list("record_key")).alias("messages"),
            F.count_distinct(values).alias("_kinds"),
        )
        .select(
            "mmsi",
            "timestamp",
            F.when(F.size("messages") == 1, F.lit("unique"))
            .when(F.col("_kinds") == 1, F.lit("duplicate"))
            .otherwise(F.lit("conflict"))
            .alias("outcome"),
            "messages",
        )
    )


def validation_report(parsed: DataFrame) -> DataFrame:
    """One row: input_rows, accepted, rejected, flagged_rows, duplicate_rows and conflict_groups of parsed rows."""
    good = parsed.filter(F.size("reasons") == 0)
    rows = parsed.agg(
        F.count(F.lit(1)).alias("input_rows"),
        F.count(F.when(F.size("reasons") == 0, 1)).alias("accepted"),
        F.count(F.when(F.size("reasons") > 0, 1)).alias("rejected"),
        F.count(F.when(F.size("quality_flags") > 0, 1)).alias("flagged_rows"),
    )
    groups = message_groups(good).agg(
        F.coalesce(F.sum(F.when(F.col("outcome") == "duplicate", F.size("messages") - 1)), F.lit(0)).alias("duplicate_rows"),
        F.count(F.when(F.col("outcome") == "conflict", 1)).alias("conflict_groups"),
    )
    return rows.crossJoin(groups)  # one row each

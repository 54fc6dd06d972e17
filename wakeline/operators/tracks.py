"""Intervals between consecutive reports of a vessel: adjacency, accept or reject, episodes, checkpoints."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.identity import fingerprint
from ..functions.projection import LocalProjection

METHOD = "straight-intervals/1"
KNOT_MS = 1852 / 3600
EVENT = (
    "record_key", "timestamp", "outcome", "scope", "signature", "longitude", "latitude", "sog_knots", "raw_vessel_code",
    "equipment_class", "imo",
)

Geometry = Callable[[Column, Column, Column, Column], Column]


@dataclass(frozen=True)
class TrackConfig:
    max_gap_seconds: float
    max_implied_speed_knots: float
    core_start: datetime
    core_end: datetime

    def __post_init__(self) -> None:
        if not 0 < self.max_gap_seconds < float("inf") or not 0 < self.max_implied_speed_knots < float("inf"):
            raise ValueError("gap and speed must be positive and finite")
        if not self.core_start < self.core_end:
            raise ValueError("the core must be positive")


def events_of(audit: DataFrame) -> DataFrame:
    """The reports that take part in adjacency: duplicates and rows without a vessel id are out."""
    ok = F.col("mmsi").rlike(r"\A[0-9]{9}\z") & (F.col("outcome") != "duplicate")
    return audit.filter(ok).select("mmsi", *EVENT)


#: Rows of a vessel from which it is cut into slices, about the rows of a slice, and the seconds of the time steps slices are made of.
SLICE_ROWS, SLICE_SECONDS = 500_000, 600


def sliced(events: DataFrame, rows: int = SLICE_ROWS, seconds: int = SLICE_SECONDS) -> DataFrame:
    """events with _slice: vessels of more than some rows in slices of their time order, others in slice 0.

    From counts by vessel and time step (combined before the shuffle), summed up for large vessels only. A slice has about
    so many rows unless one time step has more; a vessel's events without time are a step of their own, the first. The
    slice depends on nothing but the data. What comes after works slice by slice, with summaries passed from slice to slice.
    """
    step = F.coalesce(F.floor(F.unix_micros("timestamp") / F.lit(seconds * 1_000_000)), F.lit(-(2**62)))
    e = events.withColumn("_step", step)
    counts = e.groupBy("mmsi", "_step").agg(F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy("mmsi")
    large = counts.withColumn("_all", F.sum("_n").over(w)).filter(F.col("_all") > rows)
    before = F.sum("_n").over(w.orderBy("_step")) - F.col("_n")
    slices = large.select("mmsi", "_step", F.floor(before / rows).alias("_slice"))
    return e.join(slices, ["mmsi", "_step"], "left").withColumn("_slice", F.coalesce("_slice", F.lit(0))).drop("_step")


def parts_of(rows: DataFrame) -> list[str]:
    """What one task orders: a vessel, or a slice of one."""
    return ["mmsi", "_slice"] if "_slice" in rows.columns else ["mmsi"]


def passed_on(rows: DataFrame, summary: dict[str, Column], scan: dict[str, Callable[[WindowSpec, WindowSpec], Column]]) -> DataFrame:
    """rows with the results of a scan over their vessel's slices.

    summary: aggregates of each slice; scan: of each result, how it follows from them, given windows over the slices
    before and over all slices of a vessel. There is one row for each slice, so the scan is small.
    """
    s = rows.groupBy("mmsi", "_slice").agg(*[c.alias(k) for k, c in summary.items()])
    w = W.partitionBy("mmsi").orderBy("_slice")
    earlier, whole = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.select("mmsi", "_slice", *[f(earlier, whole).alias(k) for k, f in scan.items()])
    return rows.join(s, ["mmsi", "_slice"])


def numbered(rows: DataFrame, position: str = "position") -> DataFrame:
    """rows(mmsi, timestamp, record_key, ...) with their place, from 1, in the order of these three, nulls first.

    Slices are ordered by themselves, and start where the counts of all earlier slices end: sums of slice counts within
    vessels of the same first three digits (in hulls' ids, their country), and of the few sums of those before. So no task
    sees more than a slice's rows, or one country's slices.
    """
    named = rows.withColumns({"_mmsi": F.col("mmsi"), "mmsi": F.coalesce(F.concat(F.lit("v"), "mmsi"), F.lit(""))})
    cut = sliced(named)
    own = W.partitionBy("mmsi", "_slice").orderBy(F.col("timestamp").asc_nulls_first(), "record_key")
    counts = cut.groupBy("mmsi", "_slice").agg(F.count(F.lit(1)).alias("_n")).withColumn("_group", F.substring("mmsi", 1, 4))
    groups = counts.groupBy("_group").agg(F.sum("_n").alias("_all"))
    groups = groups.select("_group", (F.sum("_all").over(W.orderBy("_group")) - F.col("_all")).alias("_earlier"))
    within = F.sum("_n").over(W.partitionBy("_group").orderBy("mmsi", "_slice")) - F.col("_n")
    starts = counts.withColumn("_within", within).join(groups, "_group").select("mmsi", "_slice", (F.col("_within") + F.col("_earlier")).alias("_start"))
    placed = cut.withColumn(position, F.row_number().over(own)).join(starts, ["mmsi", "_slice"])
    placed = placed.withColumns({position: (F.col(position) + F.col("_start")).cast("long"), "mmsi": F.col("_mmsi")})
    return placed.select(*rows.columns, position)


def event_of_point(projection: LocalProjection | None = None) -> Column:
    """The carried point as an event: an ingestion's points have more columns, in another order."""
    placed = zip("xy", projection.forward(F.col("point.longitude"), F.col("point.latitude"))) if projection else ()
    return F.when(F.col("point").isNotNull(), F.struct(*[F.col(f"point.{c}").alias(c) for c in EVENT], *[v.alias(k) for k, v in placed]))


def adjacency(events: DataFrame, carry: DataFrame | None = None, projection: LocalProjection | None = None) -> DataFrame:
    """Each event with prev (the one before it in time), skip, unknown_time, carried_barrier and carry_episode.

    carry(mmsi, point struct of EVENT, barrier_seen, episode_id) stands before a vessel's first event, unless
    that is timed and earlier: then the carried point and its episode are dropped and the barrier stays.
    skip marks a repeat of the event before: it becomes the next one's prev, and is nothing else. Events of sliced() are
    ordered slice by slice, with the same result. projection: events and prev get their x and y here, once for each event,
    so that filters over decided() don't hold the projection of both ends.
    """
    placed = ()
    if projection is not None:
        placed = ("x", "y")
        events = events.withColumns(dict(zip(placed, projection.forward(F.col("longitude"), F.col("latitude")))))
    parts = W.partitionBy(*parts_of(events))
    w = parts.orderBy(F.col("timestamp").asc_nulls_first(), "record_key")
    row, order = F.struct(*EVENT, *placed), F.struct("timestamp", "record_key")
    found = {
        "prev": F.lag(row).over(w),
        "nth": F.row_number().over(w),
        "unknown_time": F.max(F.col("timestamp").isNull()).over(parts),
        "_first": F.min(order).over(parts),
    }
    e = events.select("*", *[c.alias(k) for k, c in found.items()])
    if "_slice" in events.columns:
        e = passed_on(
            e,
            {"_last": F.max_by(row, order), "_n": F.count(F.lit(1)), "_unknown": F.bool_or(F.col("timestamp").isNull()), "_least": F.min(order)},
            {
                "_before": lambda earlier, whole: F.last("_last").over(earlier),
                "_offset": lambda earlier, whole: F.coalesce(F.sum("_n").over(earlier), F.lit(0)),
                "_unknown": lambda earlier, whole: F.bool_or("_unknown").over(whole),
                "_least": lambda earlier, whole: F.min("_least").over(whole),
            },
        ).withColumns(
            {
                "prev": F.coalesce("prev", "_before"),
                "nth": (F.col("nth") + F.col("_offset")).cast("long"),
                "unknown_time": F.col("_unknown"),
                "_first": F.col("_least"),
            }
        ).drop("_before", "_offset", "_unknown", "_least")
    if carry is None:
        e = e.withColumns({"carried_barrier": F.lit(False), "carry_episode": F.lit(None).cast("string")})
    else:
        c = carry.select(
            "mmsi", event_of_point(projection).alias("_point"), F.col("barrier_seen").alias("_barrier"), F.col("episode_id").alias("_episode")
        )
        e = e.join(c, "mmsi", "left")
        # A stale first row drops the episode for all the vessel's rows.
        e = e.withColumn("_stale", F.coalesce(F.col("_first.timestamp") < F.col("_point.timestamp"), F.lit(False)))
        e = e.withColumns(
            {
                "prev": F.when((F.col("nth") == 1) & ~F.col("_stale"), F.col("_point")).otherwise(F.col("prev")),
                "carried_barrier": F.coalesce("_barrier", F.lit(False)),
                "carry_episode": F.when(~F.col("_stale"), F.col("_episode")),
            }
        ).drop("_point", "_barrier", "_episode", "_stale")
    e = e.drop("_first")
    repeat = (
        (F.col("timestamp") == F.col("prev.timestamp"))
        & (F.col("outcome") == "accepted")
        & (F.col("signature") == F.col("prev.signature"))
    )
    return e.withColumn("skip", F.coalesce(repeat, F.lit(False)))


def decided(adjacent: DataFrame, config: TrackConfig, projection: LocalProjection, screen: Geometry | None = None) -> DataFrame:
    """adjacent with intersects, duration, x1 .. y2, length_m, the interval's sorted reasons, and whether it is accepted.

    All checks before the geometry are made; the geometry is looked at only where none of them fires.
    """
    prev = lambda c: F.col(f"prev.{c}")
    start, end = prev("timestamp"), F.col("timestamp")
    core_start, core_end = F.lit(config.core_start), F.lit(config.core_end)
    has = F.col("prev").isNotNull() & ~F.col("skip")
    touches = start.isNull() | end.isNull() | ((start < core_end) & (end > core_start))
    seconds = (F.unix_micros(end) - F.unix_micros(start)) / 1e6
    blocked = F.col("unknown_time") | (F.col("carried_barrier") & (start.isNull() | (start < core_start)))
    other_imo = (F.length(prev("imo")) > 0) & (F.length("imo") > 0) & (prev("imo") != F.col("imo"))
    barrier = (prev("outcome") != "accepted") | (F.col("outcome") != "accepted")
    other = F.coalesce(other_imo, F.lit(False))
    timeless, gap = F.col("seconds").isNull() | (F.col("seconds") <= 0), F.col("seconds") > config.max_gap_seconds
    early = F.array_compact(
        F.array(
            F.when(blocked, F.lit("conservative_carry_or_unknown_time_barrier")),
            F.when(barrier, F.lit("original_adjacency_barrier")),
            F.when(other, F.lit("identity_episode_conflict")),
            F.when(timeless, F.lit("unknown_or_nonpositive_time")).when(gap, F.lit("excessive_gap")),
        )
    )
    # Booleans say what is accepted and arrays only why not: filters are pushed below and repeat what their columns are made of.
    no = lambda c: ~F.coalesce(c, F.lit(False))
    d = adjacent.withColumns({"intersects": has & touches, "seconds": F.when(has, seconds)})
    clear = no(blocked) & no(barrier) & no(other) & no(timeless) & no(gap)
    open_ = F.col("intersects") & clear
    if {"x", "y"} <= set(adjacent.columns):
        (x1, y1), (x2, y2) = (prev("x"), prev("y")), (F.col("x"), F.col("y"))
    else:
        x1, y1 = projection.forward(prev("longitude"), prev("latitude"))
        x2, y2 = projection.forward(F.col("longitude"), F.col("latitude"))
    d = d.withColumns({k: F.when(open_, v) for k, v in (("x1", x1), ("y1", y1), ("x2", x2), ("y2", y2))})
    d = d.withColumn("length_m", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    ends = tuple(F.col(c) for c in ("x1", "y1", "x2", "y2"))
    d = d.withColumn("screened", screen(*ends) if screen else F.lit(None).cast("string"))
    knots = F.when(open_, F.col("length_m") / F.col("seconds") / F.lit(KNOT_MS))
    fast = F.col("length_m") / F.col("seconds") / F.lit(KNOT_MS) * F.lit(1 + projection.metric_error_bound) > config.max_implied_speed_knots
    late = F.array_compact(
        F.array(
            F.when(F.col("length_m").isNull(), F.lit("unsupported_projection_geometry")),
            F.when(fast, F.lit("implied_speed_jump_or_threshold_uncertainty")),
            F.col("screened"),
        )
    )
    reasons = F.when(~clear, early).otherwise(F.when(open_, late).otherwise(F.array().cast("array<string>")))
    accepted = open_ & F.col("length_m").isNotNull() & no(fast) & F.col("screened").isNull()
    return d.withColumns({"implied_knots": knots, "reasons": F.array_sort(F.array_distinct(reasons)), "accepted": accepted}).drop("screened")


def episode_id(key: Column, mmsi: Column) -> Column:
    return F.when(key.isNotNull(), fingerprint({"episode_start": key, "source_mmsi": mmsi}))


def with_episodes(decisions: DataFrame) -> DataFrame:
    """decisions with rejected, breaks, episode_id (of the interval) and episode_after (of the event).

    A rejected interval in the core and any event that isn't accepted start a new episode at that event; the
    interval itself still carries the episode before it.
    """
    d = decisions.withColumn("rejected", F.col("intersects") & ~F.col("accepted"))
    d = d.withColumn("breaks", ~F.col("skip") & (F.col("rejected") | (F.col("outcome") != "accepted")))
    w = W.partitionBy(*parts_of(d)).orderBy(F.col("timestamp").asc_nulls_first(), "record_key")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    breaking, real = (F.when(c, F.col("record_key")) for c in (F.col("breaks"), ~F.col("skip")))
    last_break, first_key = F.last(breaking, ignorenulls=True).over(before), F.first(real, ignorenulls=True).over(upto)
    if "_slice" in d.columns:
        order = F.struct("timestamp", "record_key")
        d = d.withColumns({"_break": last_break, "_key": first_key})
        d = passed_on(
            d,
            {"_breaks": F.max_by("record_key", F.when(F.col("breaks"), order)), "_keys": F.min_by("record_key", F.when(~F.col("skip"), order))},
            {
                "_earlier_break": lambda earlier, whole: F.last("_breaks", ignorenulls=True).over(earlier),
                "_earlier_key": lambda earlier, whole: F.first("_keys", ignorenulls=True).over(earlier),
            },
        )
        last_break, first_key = F.coalesce("_break", "_earlier_break"), F.coalesce("_earlier_key", "_key")
    mmsi = F.col("mmsi")
    d = d.withColumn("episode_id", F.coalesce(episode_id(last_break, mmsi), "carry_episode", episode_id(first_key, mmsi)))
    own = episode_id(F.col("record_key"), mmsi)
    return d.withColumn("episode_after", F.when(F.col("breaks"), own).otherwise(F.col("episode_id"))).drop("_break", "_key", "_earlier_break", "_earlier_key")


def interval_ledger(episodes: DataFrame) -> DataFrame:
    """One row for each interval that touches the core."""
    stable = F.col("raw_vessel_code").eqNullSafe(F.col("prev.raw_vessel_code")) & F.col("equipment_class").eqNullSafe(
        F.col("prev.equipment_class")
    )
    left, right = F.col("prev.record_key"), F.col("record_key")
    return episodes.filter("intersects").select(
        fingerprint({"left": left, "right": right, "method": F.lit(METHOD)}).alias("interval_id"),
        "mmsi",
        "episode_id",
        F.lit("source_mmsi_episode_unresolved").alias("identity_status"),
        left.alias("left_record_key"),
        right.alias("right_record_key"),
        F.col("prev.timestamp").alias("start"),
        F.col("timestamp").alias("end"),
        F.when(F.col("accepted"), F.lit("accepted_estimate")).otherwise(F.lit("rejected")).alias("outcome"),
        "reasons",
        "seconds",
        "length_m",
        "implied_knots",
        "x1",
        "y1",
        "x2",
        "y2",
        F.col("prev.sog_knots").alias("left_sog"),
        F.col("sog_knots").alias("right_sog"),
        F.when(stable, F.col("raw_vessel_code")).alias("raw_vessel_code"),
        F.when(stable, F.col("equipment_class")).alias("equipment_class"),
        F.when(stable, F.lit("stable_raw_attributes")).otherwise(F.lit("endpoint_class_change_unknown")).alias("class_status"),
        F.when(
            F.col("length_m").isNotNull(),
            F.when(F.col("length_m") == 0, F.format_string("POINT (%s %s)", "x1", "y1")).otherwise(
                F.format_string("LINESTRING (%s %s, %s %s)", "x1", "y1", "x2", "y2")
            ),
        ).alias("estimated_geometry_wkt"),
    )


def checkpoint(episodes: DataFrame, config: TrackConfig, carry: DataFrame | None = None) -> DataFrame:
    """(mmsi, point, barrier_seen, episode_id): the last event without time or before core_end that is no repeat.

    barrier_seen adds up over all such events; vessels that only carry has pass through.
    """
    end = F.lit(config.core_end)
    kept = episodes.filter(~F.col("skip") & (F.col("timestamp").isNull() | (F.col("timestamp") < end)))
    seen = kept.groupBy("mmsi").agg(
        F.max_by(F.struct(F.struct(*EVENT).alias("point"), F.col("episode_after").alias("episode_id")), F.col("nth")).alias("last"),
        F.bool_or(F.col("unknown_time") | F.col("rejected") | (F.col("outcome") != "accepted")).alias("barrier"),
    )
    if carry is None:
        return seen.select("mmsi", "last.point", F.col("barrier").alias("barrier_seen"), "last.episode_id")
    c = carry.select(
        "mmsi", event_of_point().alias("_point"), F.col("barrier_seen").alias("_barrier"), F.col("episode_id").alias("_episode")
    )
    mine = F.col("last").isNotNull()
    return seen.join(c, "mmsi", "full_outer").select(
        "mmsi",
        F.when(mine, F.col("last.point")).otherwise(F.col("_point")).alias("point"),
        (F.coalesce("barrier", F.lit(False)) | F.coalesce("_barrier", F.lit(False))).alias("barrier_seen"),
        F.when(mine, F.col("last.episode_id")).otherwise(F.col("_episode")).alias("episode_id"),
    )


def merged_carry(ingested: DataFrame, tracked: DataFrame) -> DataFrame:
    """The ingestion's carry with the episode of the trajectory checkpoint (even where null) and either barrier."""
    t = tracked.select("mmsi", F.lit(True).alias("_has"), F.col("episode_id").alias("_episode"), F.col("barrier_seen").alias("_barrier"))
    j = ingested.join(t, "mmsi", "left")
    return j.select(
        "mmsi",
        "point",
        (F.col("barrier_seen") | F.coalesce("_barrier", F.lit(False))).alias("barrier_seen"),
        F.col("_episode").alias("episode_id"),
    )


def observed_points(episodes: DataFrame, projection: LocalProjection, parts: Geometry | None = None) -> DataFrame:
    """Accepted core events that are no repeats, with their cell and cell_status."""
    p = episodes.filter("outcome = 'accepted' AND scope = 'core' AND NOT skip").select("mmsi", *EVENT)
    x, y = projection.forward(F.col("longitude"), F.col("latitude"))
    p = p.withColumns({"_x": x, "_y": y})
    cell = parts(F.col("_x"), F.col("_y"), F.col("_x"), F.col("_y"))[0]["cell"] if parts else F.lit(None).cast("string")
    p = p.withColumn("cell", cell)
    status = (
        F.when(F.col("_x").isNull(), F.lit("unsupported_geometry"))
        .when(F.col("cell").isNull(), F.lit("outside_aoi"))
        .otherwise(F.lit("observed_point"))
    )
    return p.withColumn("cell_status", status).drop("_x", "_y")


def assessed(pairs: DataFrame, max_gap_seconds: float) -> DataFrame:
    """The earlier ladder over pairs(left, right: structs or null, identity_conflict): outcome, reasons, supported
    seconds (null if rejected) and stationary."""
    left, right = F.col("left"), F.col("right")
    seconds = (F.unix_micros("right.timestamp") - F.unix_micros("left.timestamp")) / 1e6
    other = (F.col("left.mmsi") != F.col("right.mmsi")) | (
        (F.length("left.imo") > 0) & (F.length("right.imo") > 0) & (F.col("left.imo") != F.col("right.imo"))
    )
    reasons = F.array_compact(
        F.array(
            F.when(left.isNull() | right.isNull(), F.lit("invalid_sample_barrier")),
            F.when(F.col("identity_conflict") | F.coalesce(other, F.lit(False)), F.lit("identity_conflict")),
            F.when(seconds <= 0, F.lit("nonpositive_or_unordered_time")).when(seconds > max_gap_seconds, F.lit("excessive_gap")),
        )
    )
    p = pairs.withColumns({"reasons": F.array_sort(F.array_distinct(reasons)), "_s": seconds})
    same = (F.col("left.longitude") == F.col("right.longitude")) & (F.col("left.latitude") == F.col("right.latitude"))
    bad = F.size("reasons") > 0
    return p.withColumns(
        {
            "outcome": F.when(bad, F.lit("rejected")).otherwise(F.lit("pending_scientific_validation")),
            "supported_seconds": F.when(~bad, F.col("_s")),
            "stationary": F.coalesce(same, F.lit(False)),
        }
    ).drop("_s")

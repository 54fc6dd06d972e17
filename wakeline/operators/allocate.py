"""Splitting accepted intervals over cells and UTC days, and checking that nothing is lost."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tracks import METHOD, Geometry


def day_bounds(start: Column, end: Column) -> Column:
    """array of instants: start, the UTC midnights strictly between, end; empty where start >= end."""
    first = F.date_trunc("day", start) + F.expr("INTERVAL 1 DAY")
    midnights = F.when(first < end, F.sequence(first, end, F.expr("INTERVAL 1 DAY"))).otherwise(F.array().cast("array<timestamp>"))
    inner = F.filter(midnights, lambda t: t < end)
    return F.when(start < end, F.concat(F.array(start), inner, F.array(end))).otherwise(F.array().cast("array<timestamp>"))


def day_slices(start: Column, end: Column) -> Column:
    """array<struct<begin, finish>> of consecutive day_bounds."""
    b = day_bounds(start, end)
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(b) - 1, F.lit(1))),
        lambda i: F.struct(F.get(b, i - 1).alias("begin"), F.get(b, i).alias("finish")),
    )


def cut(intervals: DataFrame, core_start: datetime, core_end: datetime, parts: Geometry) -> DataFrame:
    """The accepted intervals, a row for each spatial part p and UTC day s: from u to v as shares, begin, finish, part_seconds.

    Rows that are no piece (v <= u, or no time left by rounding) stay, so each interval has a row even if it has no part.
    """
    ends = tuple(F.col(c) for c in ("x1", "y1", "x2", "y2"))
    i = intervals.filter("outcome = 'accepted_estimate'").withColumn("parts", parts(*ends))
    lo, hi = F.greatest("start", F.lit(core_start)), F.least("end", F.lit(core_end))
    i = i.withColumn("slices", day_slices(lo, hi)).withColumn("n_parts", F.size("parts"))
    # Outer, as explode filters by its array below the projection that makes it, so parts would be made twice.
    i = i.select("*", F.explode_outer("parts").alias("p"))
    i = i.select("*", F.explode_outer("slices").alias("s")).drop("parts", "slices")
    share = lambda t: (F.unix_micros(t) - F.unix_micros("start")) / 1e6 / F.col("seconds")
    i = i.withColumns({"u": F.greatest(F.col("p.lo"), share("s.begin")), "v": F.least(F.col("p.hi"), share("s.finish"))})
    instant = lambda t: F.timestamp_micros(F.unix_micros("start") + F.rint(t * F.col("seconds") * 1e6).cast("long"))
    i = i.withColumns({"begin": instant(F.col("u")), "finish": instant(F.col("v"))})
    return i.withColumn("part_seconds", (F.unix_micros("finish") - F.unix_micros("begin")) / 1e6)


def pieces(cut_: DataFrame) -> DataFrame:
    """cut's rows with _piece: whether the row is a piece, that is, a contribution of allocate."""
    ok = F.col("p").isNotNull() & F.col("s").isNotNull() & (F.col("v") > F.col("u")) & (F.col("part_seconds") > 0)
    return cut_.withColumn("_piece", F.coalesce(ok, F.lit(False)))


def allocate(intervals: DataFrame, core_start: datetime, core_end: datetime, resolution: int, parts: Geometry) -> DataFrame:
    """Additive contributions of the accepted intervals: one row for each spatial part and UTC day.

    The part of an interval in the core is covered, inside cells and outside them (cell null). Instants are
    rounded to microseconds, so slivers below that have no row; distances come from unrounded shares.
    """
    i = cut(intervals, core_start, core_end, parts).filter("p IS NOT NULL AND s IS NOT NULL AND v > u AND part_seconds > 0")
    known = F.col("left_sog").isNotNull() & F.col("right_sog").isNotNull()
    middle = (F.col("u") + F.col("v")) / 2
    return i.select(
        "interval_id",
        "mmsi",
        "episode_id",
        "identity_status",
        F.col("p.cell").alias("cell"),
        F.lit(resolution).cast("tinyint").alias("resolution"),
        F.to_date("begin").alias("utc_date"),
        F.col("begin").alias("start"),
        F.col("finish").alias("end"),
        F.col("part_seconds").alias("seconds"),
        (F.col("part_seconds") / 3600).alias("vessel_hours"),
        (F.col("length_m") / 1000 * (F.col("v") - F.col("u"))).alias("distance_km"),
        F.when(known, F.col("part_seconds") * (F.col("left_sog") + (F.col("right_sog") - F.col("left_sog")) * middle)).alias(
            "reported_sog_integral_knot_seconds"
        ),
        F.when(known, F.col("part_seconds")).otherwise(0.0).alias("speed_supported_seconds"),
        F.when(known, F.lit("supported_estimate")).otherwise(F.lit("unknown")).alias("reported_sog_status"),
        "raw_vessel_code",
        "equipment_class",
        "class_status",
        "left_record_key",
        "right_record_key",
        F.lit(METHOD).alias("method"),
        F.when(F.col("length_m") > 0, F.col("n_parts")).otherwise(0).alias("n_parts"),
    )


def rolled_up(
    intervals: DataFrame, contributions: DataFrame, core_start: datetime, core_end: datetime, tolerance_m: float = 0.001
) -> DataFrame:
    """intervals with owned_seconds, distance_km, the sums inside and outside cells, and the numerical bound."""
    inside = F.col("cell").isNotNull()
    total = lambda c, ok: F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0.0))
    sums = contributions.groupBy("interval_id").agg(
        total("seconds", inside).alias("inside_seconds"),
        total("seconds", ~inside).alias("outside_seconds"),
        total("distance_km", inside).alias("inside_km"),
        total("distance_km", ~inside).alias("outside_km"),
        (F.max("n_parts") * 2 * tolerance_m).alias("numerical_allocation_error_bound_m"),
    )
    return intervals.join(sums, "interval_id", "left").withColumns(owned(core_start, core_end))


def owned(core_start: datetime, core_end: datetime) -> dict[str, Column]:
    """owned_seconds and distance_km of the part of accepted intervals in the core."""
    accepted = F.col("outcome") == "accepted_estimate"
    seconds = (F.unix_micros(F.least("end", F.lit(core_end))) - F.unix_micros(F.greatest("start", F.lit(core_start)))) / 1e6
    km = F.col("length_m") / 1000 * seconds / F.col("seconds")
    return {"owned_seconds": F.when(accepted, seconds), "distance_km": F.when(accepted, km)}


def rolled_up_rows(rows: DataFrame, core_start: datetime, core_end: datetime) -> DataFrame:
    """What rolled_up says of the accepted intervals in time and distance, from the rows of pieces().

    What is said of an interval is in each of its rows, so intervals aren't made a second time and joined, and only sums are shuffled.
    """
    rows = rows.withColumns(owned(core_start, core_end) | {"_km": F.col("length_m") / 1000 * (F.col("v") - F.col("u"))})
    cell = F.col("p.cell")
    total = lambda c, inside: F.coalesce(F.sum(F.when(F.col("_piece") & inside, F.col(c))), F.lit(0.0))
    return rows.groupBy("interval_id", "right_record_key", "outcome", "owned_seconds", "distance_km").agg(
        total("part_seconds", cell.isNotNull()).alias("inside_seconds"),
        total("part_seconds", cell.isNull()).alias("outside_seconds"),
        total("_km", cell.isNotNull()).alias("inside_km"),
        total("_km", cell.isNull()).alias("outside_km"),
    )


def conserved(ledger: DataFrame, seconds_tolerance: float, km_tolerance: float) -> DataFrame:
    """ledger unchanged; reading it fails where the parts of an interval don't add up to it."""
    off = (F.abs(F.col("inside_seconds") + F.col("outside_seconds") - F.col("owned_seconds")) > seconds_tolerance) | (
        F.abs(F.col("inside_km") + F.col("outside_km") - F.col("distance_km")) > km_tolerance
    )
    lost = (F.col("outcome") == "accepted_estimate") & F.coalesce(off, F.lit(True))
    return ledger.filter(F.when(lost, F.raise_error(F.concat(F.lit("allocation isn't conserved: "), "interval_id"))).otherwise(F.lit(True)))


def conservation_faults(intervals: DataFrame, parts: DataFrame, seconds_tolerance: float, km_tolerance: float) -> DataFrame:
    """(interval_id, fault) of intervals(interval_id, mmsi, start, end, distance_km) that their parts
    (with variant) don't tile: wrong vessel, gap or overlap, several variants, wrong end, wrong distance."""
    i = intervals.select("interval_id", F.col("mmsi").alias("_mmsi"), F.col("start").alias("_start"), F.col("end").alias("_end"),
                         F.col("distance_km").alias("_km"))
    return tiling_faults(i.join(parts, "interval_id", "left"), ["interval_id"], seconds_tolerance, km_tolerance).select("interval_id", "fault")


def tiling_faults(rows: DataFrame, keys: list[str], seconds_tolerance: float, km_tolerance: float) -> DataFrame:
    """keys and fault of intervals (their keys, _mmsi, _start, _end, _km in each row) that their parts don't tile.

    rows have one part each (mmsi, start, end, distance_km, variant), all null where an interval has none.
    """
    w = W.partitionBy(*keys).orderBy("start", "end")
    p = rows.withColumn("_from", F.coalesce(F.lag("end").over(w), "_start"))
    gap = F.abs(F.unix_micros("start") - F.unix_micros("_from")) / 1e6 > seconds_tolerance
    sums = p.groupBy(*keys).agg(
        F.bool_or(F.col("mmsi") != F.col("_mmsi")).alias("other"),
        F.bool_or(gap).alias("gap"),
        F.count_distinct("variant").alias("variants"),
        F.count("start").alias("n"),
        (F.abs(F.max(F.unix_micros("end")) - F.max(F.unix_micros("_end"))) / 1e6).alias("short"),
        F.abs(F.sum("distance_km") - F.max("_km")).alias("km"),
    )
    fault = (
        F.when(F.col("n") == 0, F.lit("no_parts"))
        .when(F.col("other"), F.lit("parent_or_identity_mismatch"))
        .when(F.col("gap"), F.lit("overlap_or_gap"))
        .when((F.col("variants") != 1) | (F.col("short") > seconds_tolerance), F.lit("not_one_covering_variant"))
        .when(F.col("km") > km_tolerance, F.lit("distance_not_conserved"))
    )
    return sums.select(*keys, fault.alias("fault")).filter("fault IS NOT NULL")


def contribution_faults(parts: DataFrame) -> DataFrame:
    """(interval_id, fault) of contributions that can't stand by themselves, whatever their interval: no time, an
    amount that is negative or no number, or speed support that fits neither the time nor the integral."""
    amount = lambda c: ~F.isnan(c) & (F.col(c) >= 0) & (F.col(c) < float("inf"))
    integral, support = F.col("reported_sog_integral_knot_seconds"), F.col("speed_supported_seconds")
    duration = (F.unix_micros("end") - F.unix_micros("start")) / 1e6
    fault = (
        F.when(~F.coalesce(duration > 0, F.lit(False)), F.lit("no_duration"))
        .when(F.col("interval_id").isNull() | F.col("mmsi").isNull(), F.lit("no_identity"))
        .when(~F.coalesce(amount("distance_km") & amount("speed_supported_seconds"), F.lit(False)), F.lit("bad_amount"))
        .when(integral.isNotNull() & ~amount("reported_sog_integral_knot_seconds"), F.lit("bad_amount"))
        .when(support > duration, F.lit("support_longer_than_part"))
        .when(integral.isNotNull() != (support > 0), F.lit("support_without_integral_or_reverse"))
    )
    return parts.select("interval_id", fault.alias("fault")).filter("fault IS NOT NULL")

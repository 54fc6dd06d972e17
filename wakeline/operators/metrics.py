"""Daily metrics of cells, their definitions and envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tracks import numbered

#: Name, unit, kind and reduction of the metrics.
METRICS = (
    ("unique_observed_vessels", "identities/window", "point_observation", "identity union; never sum subgroup counts"),
    ("unique_estimated_present_vessels", "identities/window", "track_estimate", "identity union; never sum subgroup counts"),
    ("vessel_hours", "vessel h", "track_estimate", "sum"),
    ("vessel_km", "vessel km", "track_estimate", "sum"),
    ("reported_sog_time_weighted_knots", "knots", "reported_speed_reduction", "sum knot-seconds / sum supported seconds"),
    ("speed_band_hours", "vessel h", "track_estimate", "sum within same variant/band"),
    ("mean_supported_concurrency", "vessels", "track_estimate", "sum vessel-hours / window hours"),
)
STATUSES = ("observed", "unavailable", "unknown", "not_applicable", "partial")


def metric_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(METRICS), "name string, unit string, method_kind string, reduction string")


def daily_metrics(contributions: DataFrame, window_hours: float = 24.0, **more: Column) -> DataFrame:
    """One row for each cell and UTC day from contributions: present vessels, hours, km, speed, concurrency.

    The mean speed is null where no second has support; it is never zero for want of data. more: further aggregates.
    """
    c = contributions.filter("cell IS NOT NULL").groupBy("cell", "utc_date")
    support = F.sum("speed_supported_seconds")
    return c.agg(
        F.count_distinct("mmsi").alias("unique_estimated_present_vessels"),
        (F.sum("seconds") / 3600).alias("vessel_hours"),
        F.sum("distance_km").alias("vessel_km"),
        (F.sum("reported_sog_integral_knot_seconds") / F.when(support > 0, support)).alias("reported_sog_time_weighted_knots"),
        (F.sum("seconds") / 3600 / window_hours).alias("mean_supported_concurrency"),
        *[column.alias(name) for name, column in more.items()],
    )


def observed_vessels(points: DataFrame) -> DataFrame:
    """unique_observed_vessels of each cell and UTC day; a union of identities, so not additive."""
    return (
        points.filter("cell IS NOT NULL")
        .groupBy("cell", F.to_date("timestamp").alias("utc_date"))
        .agg(F.count_distinct("mmsi").alias("unique_observed_vessels"))
    )


#: Vessels of a container up to which their positions are listed; above it, a bit for each position is smaller.
LISTED = 1024


def vessel_numbers(points: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """mmsi, number: dense numbers from 1 for the vessels of points. known: earlier numbers, which stay; new ones follow them.

    Bitmaps of different runs can be merged only if they come from one chain of such tables.
    """
    new = points.select("mmsi").filter("mmsi IS NOT NULL").distinct()
    first = F.lit(0)
    if known is not None:
        new = new.join(known, "mmsi", "left_anti")
        first = known.agg(F.coalesce(F.max("number"), F.lit(0))).scalar()
    placed = numbered(new.withColumns({"timestamp": F.lit(None).cast("timestamp"), "record_key": F.lit("")}), "number")
    placed = placed.select("mmsi", (F.col("number") + first).alias("number"))
    return placed if known is None else known.select("mmsi", "number").unionByName(placed)


def vessel_bitmaps(points: DataFrame, numbers: DataFrame) -> DataFrame:
    """The vessels of each cell and UTC day, exactly and mergeable: cell, utc_date, bucket, listed, bits.

    A container holds the 32,768 numbers of a bucket: as a list of positions where they are few, else as a bitmap. So it is 4 KB at
    most, and windows of any length are unions of containers, without another scan of the points.
    """
    p = points.filter("cell IS NOT NULL").select("cell", F.to_date("timestamp").alias("utc_date"), "mmsi").distinct().join(numbers, "mmsi")
    held = p.select("cell", "utc_date", F.bitmap_bucket_number("number").alias("bucket"), F.bitmap_bit_position("number").alias("position"))
    c = held.groupBy("cell", "utc_date", "bucket").agg(F.collect_list("position").alias("listed"), F.bitmap_construct_agg("position").alias("bits"))
    few = F.size("listed") <= LISTED
    return c.select("cell", "utc_date", "bucket", F.when(few, F.array_sort("listed")).alias("listed"), F.when(~few, F.col("bits")).alias("bits"))


def vessels_of_windows(bitmaps: DataFrame, window: Column) -> DataFrame:
    """unique_observed_vessels of each cell and window (a column over utc_date, or several exploded): the identity union,
    from containers alone, with one shuffle of them."""
    key = ["cell", "window_start", "bucket"]
    c = bitmaps.withColumn("window_start", window).select(*key, F.explode_outer("listed").alias("position"), "bits")
    both = c.groupBy(*key).agg(F.bitmap_construct_agg("position").alias("_listed"), F.bitmap_or_agg("bits").alias("_bits"))
    merged = both.select(*key, F.explode(F.array("_listed", "_bits")).alias("bits")).groupBy(*key).agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy("cell", "window_start").agg(F.sum(F.bitmap_count("bits")).alias("unique_observed_vessels"))


def speed_band_hours(contributions: DataFrame, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """Hours of each cell, day and band [from, to) of the mean reported speed; without support: unknown."""
    speed = F.col("reported_sog_integral_knot_seconds") / F.when(F.col("speed_supported_seconds") > 0, F.col("speed_supported_seconds"))
    band = F.coalesce(*[F.when((speed >= a) & (speed < b), F.lit(k)) for k, (a, b) in bands.items()], F.lit("unknown"))
    return (
        contributions.filter("cell IS NOT NULL")
        .groupBy("cell", "utc_date", band.alias("band"))
        .agg((F.sum("seconds") / 3600).alias("band_hours"))
    )


def envelope(value: Column, status: Column, reason: Column, available: Column, expected: Column) -> Column:
    """struct<value, status, reason, available, expected, valid>: a value only where observed or partial."""
    has = status.isin("observed", "partial")
    kept = F.when(has, value)
    valid = (
        status.isin(*STATUSES)
        & ((status != "observed") | kept.isNotNull())
        & ((status == "observed") | (F.length(reason) > 0))
        & ((status != "partial") | kept.isNull() | (available > 0))
        & (available <= expected)
        & (kept.isNull() | ~F.isnan(kept))
    )
    return F.struct(
        kept.alias("value"), status.alias("status"), reason.alias("reason"), available.alias("available"),
        expected.alias("expected"), F.coalesce(valid, F.lit(False)).alias("valid"),
    )


def coverage(definition: str, unit: str, evidence: list[str], available: Column, expected: Column) -> Column:
    """What a value rests on: support of one metric that was there and that could have been, in a unit, with evidence."""
    if not definition or not unit or not evidence or not all(evidence):
        raise ValueError("coverage needs its meaning, unit and evidence")
    return F.struct(
        F.lit(definition).alias("definition"), available.cast("double").alias("available"), expected.cast("double").alias("expected"),
        F.lit(unit).alias("unit"), F.array(*map(F.lit, evidence)).alias("evidence"),
    )


def metric_value(value: Column, method: str, support: Column) -> Column:
    """struct<value, status, reason, method, coverage> by the support: all of it observed, some partial, none unknown.

    A value is null where nothing supports it, never zero; a missing support is unknown too.
    """
    if not method:
        raise ValueError("a value needs its method")
    have, want = support["available"], support["expected"]
    status = F.when((have > 0) & (have < want), "partial").when((have >= want) & value.isNotNull(), "observed").otherwise("unknown")
    reason = F.when(status == "partial", "part of the expected support").when(status == "unknown", "no support")
    kept = F.when(status != "unknown", value.cast("double"))
    return F.struct(kept.alias("value"), status.alias("status"), reason.alias("reason"), F.lit(method).alias("method"), support.alias("coverage"))


def value_fault(m: Column) -> Column:
    """The first rule that a metric_value breaks, or null."""
    value, status, have, want = m["value"], m["status"], m["coverage"]["available"], m["coverage"]["expected"]
    endless = lambda c: F.isnan(c) | (c < 0) | (c == float("inf"))
    has = value.isNotNull()
    rules = {
        "unknown_status": ~F.coalesce(status.isin(*STATUSES), F.lit(False)),
        "coverage_not_finite": F.coalesce(endless(have), F.lit(False)) | F.coalesce(endless(want), F.lit(False)),
        "available_exceeds_expected": have > want,
        "value_not_finite": has & endless(value),
        "observed_without_value": (status == "observed") & ~has,
        "unsupported_not_null": ~status.isin("observed", "partial") & has,
        "no_reason": (status != "observed") & (F.length(F.coalesce(m["reason"], F.lit(""))) == 0),
        "partial_without_support": (status == "partial") & has & ~F.coalesce((have > 0) & (want > 0), F.lit(False)),
    }
    return F.coalesce(*[F.when(broken, F.lit(name)) for name, broken in rules.items()])


def daily_exports(contributions: DataFrame, variant: str, method: str, sources: list[str], **spatial: object) -> DataFrame:
    """cell, window_start, window_end, variant, config, sources, method, metrics (name to metric_value) of each cell and UTC day.

    Refused unless domain, geometry_version and resolution are set. The mean speed rests on the seconds with reported speeds at
    both ends, the others on all accepted seconds. Metrics that break a rule are found with value_fault, rows with export_faults.
    """
    spatial_selection(**spatial)
    if not variant or not sources or not all(sources):
        raise ValueError("an export needs its variant and sources")
    key = ["cell", "utc_date"]
    d = daily_metrics(contributions, _all=F.sum("seconds"), _speed=F.sum("speed_supported_seconds"))
    reported = coverage("seconds with a reported speed at both ends", "vessel s", sources, F.coalesce("_speed", F.lit(0.0)), F.col("_all"))
    accepted = coverage("seconds of accepted intervals", "vessel s", sources, F.col("_all"), F.col("_all"))
    entries = []
    for name in (c for c in d.columns if c not in (*key, "_all", "_speed")):
        entries += [F.lit(name), metric_value(F.col(name), method, reported if name.startswith("reported") else accepted)]
    day = F.col("utc_date").cast("timestamp")
    config = ";".join(f"{k}={v}" for k, v in sorted(spatial.items()))
    return d.select(
        "cell", day.alias("window_start"), (day + F.expr("INTERVAL 1 DAY")).alias("window_end"), F.lit(variant).alias("variant"), F.lit(config).alias("config"),
        F.array(*map(F.lit, sources)).alias("sources"), F.lit(method).alias("method"), F.create_map(*entries).alias("metrics"),
    )


def export_faults(exports: DataFrame) -> DataFrame:
    """Faults of exports(cell, window_start, window_end, variant, config, metrics map): repeated keys, windows that
    aren't one UTC day, and mixed configurations of the batch."""
    keys = exports.groupBy("cell", "window_start", "window_end", "variant").agg(F.count(F.lit(1)).alias("n"))
    repeated = keys.filter("n > 1").select("cell", "variant", F.lit("duplicate_key").alias("fault"))
    day = F.expr("window_end = window_start + INTERVAL 1 DAY AND window_start = date_trunc('day', window_start)")
    uneven = exports.filter(~day).select("cell", "variant", F.lit("not_one_utc_day").alias("fault"))
    kinds = exports.agg(
        F.count_distinct("config", "variant", F.array_join(F.array_sort(F.map_keys("metrics")), ",")).alias("kinds")
    )
    mixed = kinds.filter("kinds > 1").select(
        F.lit(None).cast("string").alias("cell"), F.lit(None).cast("string").alias("variant"), F.lit("mixed_batch").alias("fault")
    )
    return repeated.unionByName(uneven).unionByName(mixed)


def spatial_selection(**settings: object) -> None:
    """Refuse an export whose domain, geometry version or resolution is left open; all that are missing are named."""
    missing = [name for name in ("domain", "geometry_version", "resolution") if settings.get(name) in (None, "")]
    if missing:
        raise ValueError(f"an export over space needs {', '.join(missing)}")

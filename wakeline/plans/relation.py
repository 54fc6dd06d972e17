"""Position reports derived from the events table, the input of the registered queries.

The vessel count k grows with the table, so reports of one vessel stay about equally dense at every size.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import record_key, retained_signature
from ..functions.parsing import HEADERS, LEGACY, Parser
from ..functions.projection import LocalProjection
from ..operators.reconcile import SpatialFilter, TimeWindow, reconciled, with_scope
from ..operators.tracks import TrackConfig, events_of, sliced

UTC = timezone.utc
PROJECTION = LocalProjection(20.0, 10.0, 50_000.0, 0.007)
FIRST, LAST = datetime(2020, 1, 1, tzinfo=UTC), datetime(2025, 1, 1, tzinfo=UTC)
#: The core that windowed queries use, and where the carried state is cut.
CORE_START, CORE_END = datetime(2024, 1, 5, tzinfo=UTC), datetime(2024, 1, 20, tzinfo=UTC)
SPATIAL = SpatialFilter("events-rectangle", 19.95, 9.95, 20.05, 10.05, 0.01)
WINDOW = TimeWindow(CORE_START, CORE_END, datetime(2024, 1, 4, tzinfo=UTC), datetime(2024, 1, 21, tzinfo=UTC))
TRACKS = TrackConfig(1800, 90, FIRST, LAST)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with their vessel id; k is one scalar of the whole table."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = e.agg(F.greatest(F.lit(1), (F.count(F.lit(1)) / 2000).cast("bigint")).alias("k")).scalar()
    mmsi = F.lpad((F.lit(200000000) + F.col("user_id") % k).cast("string"), 9, "0")
    return e.withColumns({"mmsi": mmsi, "ts": F.col("ts").cast("timestamp_ntz")})


def positions(spark: SparkSession, sf_dir: str, copies: bool = False) -> DataFrame:
    """A report of each event: event_id, record_key, mmsi, timestamp, longitude, latitude, sog_knots, ... , signature.

    copies adds every tenth event twice more: unchanged, and moved by 0.01 degrees for every thirtieth.
    """
    e = events(spark, sf_dir).withColumns({"copy": F.lit(0), "shift": F.lit(0.0)})
    if copies:
        moved = F.when(F.col("event_id") % 30 == 0, 0.01).otherwise(0.0)
        e = e.unionByName(e.filter("event_id % 10 = 0").withColumns({"copy": F.lit(1), "shift": moved}))
    p = e.select(
        "event_id",
        F.concat(record_key(F.lit("events"), F.col("event_id")), F.when(F.col("copy") == 1, F.lit("c")).otherwise(F.lit(""))).alias("record_key"),
        "mmsi",
        F.col("ts").cast("timestamp").alias("timestamp"),
        (F.lit(19.9) + ((F.col("event_id") * 37) % 2000) / F.lit(10000.0) + F.col("shift")).alias("longitude"),
        (F.lit(9.9) + ((F.col("event_id") * 53) % 2000) / F.lit(10000.0)).alias("latitude"),
        F.when(F.col("value") <= 99.9, F.col("value")).alias("sog_knots"),
        F.col("event_type").alias("raw_vessel_code"),
        F.when(F.col("event_id") % 3 == 0, F.lit("A")).when(F.col("event_id") % 3 == 1, F.lit("B")).alias("equipment_class"),
        F.lit(None).cast("string").alias("imo"),
        F.when(F.col("value") <= 99.9, F.array().cast("array<string>")).otherwise(F.array(F.lit("invalid_or_sentinel_sog"))).alias("quality_flags"),
    )
    return p.withColumn("signature", retained_signature())


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rows of the legacy era, with a share of each kind of bad value."""
    e, i = events(spark, sf_dir), F.col("event_id")
    when = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    time = (
        F.when(i % 11 == 0, when)
        .when(i % 13 == 0, F.concat(when, F.lit("+01:30")))
        .when(i % 17 == 0, F.lit("2024-02-30T00:00:00Z"))
        .when(i % 19 == 0, F.concat(F.lit("2017"), F.substring(when, 5, 15), F.lit("Z")))
        .when(i % 23 == 0, F.concat(F.substring(when, 1, 16), F.lit("Z")))
        .otherwise(F.concat(when, F.lit("Z")))
    )
    text = lambda n: F.concat((F.floor(n / 10000)).cast("string"), F.lit("."), F.lpad((n % 10000).cast("string"), 4, "0"))
    lat, lon = text(99000 + (i * 53) % 2000), text(199000 + (i * 37) % 2000)
    values = {
        "MMSI": F.when(i % 29 == 0, F.lit("12345")).otherwise(F.concat(F.lit(" "), F.col("mmsi"), F.lit("\t"))),
        "BaseDateTime": time,
        "LAT": F.when(i % 97 == 0, F.lit("91")).when(i % 101 == 0, F.lit("nan")).otherwise(lat),
        "LON": F.when(i % 103 == 0, F.lit("")).otherwise(lon),
        "SOG": F.when(i % 7 == 0, F.lit(" NA ")).when(i % 31 == 0, F.lit("fast")).otherwise(F.col("value").cast("string")),
        "VesselType": F.when(i % 5 == 0, F.lit("null")).otherwise(F.col("event_type")),
        "TransceiverClass": F.when(i % 3 == 0, F.lit("A")).when(i % 3 == 1, F.lit("C")).otherwise(F.lit("")),
        "IMO": F.lit(""),
    }
    return e.select("event_id", *[values.get(h, F.lit("")).alias(h) for h in HEADERS[LEGACY]])


def parsed(spark: SparkSession, sf_dir: str, policy: str = "reject") -> DataFrame:
    return Parser(LEGACY, policy).parse(raw_rows(spark, sf_dir))


def made_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id and a cell id of its bits: any resolution, base cells to 127, digits that are 7 at times, other faults by rule."""
    e, i = events(spark, sf_dir), F.col("event_id")
    digit = lambda k: F.pmod(F.floor(i / (3 * k + 1)) + k * F.col("user_id"), F.when(i % 5 == 0, 8).when(i % 3 == 0, 2).otherwise(7))
    r = F.col("r")
    e = e.withColumns({"r": F.when(i % 2 == 0, F.lit(7)).otherwise(F.floor(i / 2) % 16)})
    d = F.lit(0).cast("long")
    for k in range(1, 16):
        d = d * 8 + F.when(r >= k, digit(k)).when((i % 31 == 0) & (r == k - 1), F.lit(6)).otherwise(F.lit(7))
    mode = F.when(i % 37 == 0, F.lit(2)).when(i % 41 == 0, F.lit(9)).otherwise(F.lit(1))
    base = F.when(i % 4 == 1, F.lit(14)).when(i % 4 == 2, F.lit(117)).otherwise(F.col("user_id") % 128)
    e = e.withColumns({"d": d, "top": (mode * 128 + r).cast("long") * 128 + base})
    cell = F.lower(F.hex(F.col("top") * F.lit(1 << 45) + F.col("d")))
    odd = F.when(i % 43 == 0, F.upper(cell)).when(i % 47 == 0, F.concat(F.lit("0"), cell)).when(i % 53 == 0, F.concat(cell, F.lit(" ")))
    return e.select("event_id", F.when(i % 59 != 0, F.coalesce(odd, cell)).alias("cell"))


def scoped(spark: SparkSession, sf_dir: str, copies: bool = False) -> DataFrame:
    """positions with declared window, reasons, outcome and scope."""
    p = positions(spark, sf_dir, copies).withColumns(
        {
            "reasons": F.array().cast("array<string>"),
            "declared_start": F.lit(datetime(2024, 1, 3, tzinfo=UTC)),
            "declared_end": F.lit(datetime(2024, 1, 25, tzinfo=UTC)),
        }
    )
    return with_scope(p, SPATIAL, WINDOW)


def carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A carried endpoint for each vessel: its smallest report of the core's first days, moved for odd events."""
    w = scoped(spark, sf_dir).filter("outcome = 'candidate'")
    first = w.groupBy("mmsi").agg(F.min_by(F.struct("timestamp", "record_key", "signature", "event_id"), F.struct("timestamp", "record_key")).alias("r"))
    return first.select(
        "mmsi",
        "r.timestamp",
        F.when(F.col("r.event_id") % 2 == 0, F.col("r.signature")).otherwise(F.lit("different")).alias("signature"),
        F.concat(F.lit("carry:"), F.col("r.record_key")).alias("record_key"),
    )


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconciled(scoped(spark, sf_dir, copies=True))


def track_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted reports, but every 89th filtered."""
    return positions(spark, sf_dir).withColumns(
        {
            "outcome": F.when(F.col("event_id") % 89 == 0, F.lit("filtered")).otherwise(F.lit("accepted")),
            "scope": F.when(F.col("event_id") % 89 == 0, F.lit("outside")).otherwise(F.lit("core")),
        }
    )


def crowded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with nine tenths of all reports from one vessel, cut into slices."""
    e = track_events(spark, sf_dir)
    one = e.withColumn("mmsi", F.when(F.col("event_id") % 10 < 9, F.lit("200000000")).otherwise(F.col("mmsi")))
    return sliced(events_of(one), rows=2000, seconds=3600)

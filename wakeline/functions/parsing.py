"""Parsing position reports from text: one expression for each field, reasons and flags as arrays."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields of the two eras and the columns that carry the retained roles.
LEGACY, CURRENT = "2018-2024", "2025+"
HEADERS = {
    LEGACY: (
        "MMSI", "BaseDateTime", "LAT", "LON", "SOG", "COG", "Heading", "VesselName", "IMO", "CallSign", "VesselType",
        "Status", "Length", "Width", "Draft", "Cargo", "TransceiverClass",
    ),
    CURRENT: (
        "mmsi", "base_date_time", "longitude", "latitude", "sog", "cog", "heading", "vessel_name", "imo", "call_sign",
        "vessel_type", "status", "length", "width", "draft", "cargo", "transceiver",
    ),
}
ROLES = {
    LEGACY: dict(mmsi="MMSI", time="BaseDateTime", lat="LAT", lon="LON", sog="SOG", code="VesselType", equipment="TransceiverClass", imo="IMO"),
    CURRENT: dict(
        mmsi="mmsi", time="base_date_time", lat="latitude", lon="longitude", sog="sog", code="vessel_type", equipment="transceiver", imo="imo"
    ),
}
MAX_SOG = {LEGACY: 102.2, CURRENT: 99.9}
TIME_POLICIES = ("reject", "dictionary_utc")

BLANK = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"
EVENT_TIME = r"\A\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]([01]\d|2[0-3]):[0-5]\d)?\z"
NUMBER = r"\A[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?\z"


def check_headers(headers: list[str], era: str) -> None:
    """The era's field set, in any order and without repeats."""
    if era not in HEADERS:
        raise ValueError(f"unknown source era {era}")
    if len(set(headers)) != len(headers):
        raise ValueError("a column name repeats")
    if set(headers) != set(HEADERS[era]):
        raise ValueError(f"the columns are not those of era {era}")


def stripped(c: Column) -> Column:
    """c without white space of any kind at its ends (trim() takes spaces only)."""
    return F.regexp_replace(c, rf"\A{BLANK}|{BLANK}\z", "")


def present(s: Column) -> Column:
    """Null for stripped text that stands for nothing: blank, null, nan and na in any case."""
    return F.when(~F.lower(s).isin("", "null", "nan", "na"), s)


def optional(c: Column) -> Column:
    """Null for blank, null, nan and na in any case, else the stripped text."""
    return present(stripped(c))


def valid_mmsi(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\A[0-9]{9}\z"), F.lit(False))


def decimal_text(s: Column) -> Column:
    """The double that stripped decimal text says, perhaps infinite; the gate keeps out what only one of two engines would read."""
    return F.when(s.rlike(NUMBER), F.replace(s, F.lit("_"), F.lit("")).try_cast("double"))


def number(c: Column) -> Column:
    """A finite decimal number, else null."""
    value = decimal_text(stripped(c))
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def is_naive(c: Column) -> Column:
    return ~c.rlike(r"(Z|[+-]\d{2}:\d{2})\z")


def event_time(c: Column) -> Column:
    """The instant of a full date and time through seconds; a time without zone is read as UTC; else null.

    The local part is read as UTC and the offset subtracted, as casts refuse offsets beyond 18 hours.
    """
    local = F.regexp_extract(c, r"\A(.{19}(\.\d+)?)", 1)
    sign = F.when(F.substring(c, -6, 1) == "-", -1).otherwise(1)
    offset = F.when(
        c.rlike(r"[+-]\d{2}:\d{2}\z"),
        sign * (F.substring(c, -5, 2).try_cast("int") * 3600 + F.substring(c, -2, 2).try_cast("int") * 60),
    ).otherwise(F.lit(0))
    micros = F.unix_micros(F.concat(local, F.lit("Z")).try_cast("timestamp")) - offset.cast("long") * 1_000_000
    return F.when(c.rlike(EVENT_TIME), F.timestamp_micros(micros))


@dataclass(frozen=True)
class Parser:
    """Parses raw rows of one era. The session's time zone must be UTC.

    A local time that leaves the years 1 to 9999 by its offset is rejected like any bad time.
    """

    era: str
    time_policy: str = "reject"

    def __post_init__(self) -> None:
        if self.era not in ROLES:
            raise ValueError(f"unknown source era {self.era}")
        if self.time_policy not in TIME_POLICIES:
            raise ValueError(f"time policy must be one of {TIME_POLICIES}")

    def parse(self, raw: DataFrame) -> DataFrame:
        """raw with the parsed columns added; with any reason all values but mmsi are null and flags empty.

        In stages, each of which names only columns of the one before, so that no expression is evaluated twice: stripped
        texts, typed values, tests, then reasons, flags and what is kept.
        """
        role = {k: F.col(f"`{v}`") for k, v in ROLES[self.era].items()}
        # Legacy and current columns differ in case only for some names, so raw columns go by a struct.
        texts = raw.select(F.struct("*").alias("raw"), role["time"].alias("_time"), *[stripped(role[k]).alias(k) for k in role if k != "time"])
        values = texts.select(
            "raw",
            "mmsi",
            F.coalesce(is_naive(F.col("_time")), F.lit(False)).alias("naive"),
            event_time(F.col("_time")).alias("ts"),
            *[decimal_text(F.col(k)).alias(k) for k in ("lat", "lon")],
            present(F.col("sog")).alias("speed_text"),
            decimal_text(F.col("sog")).alias("speed"),
            *[present(F.col(k)).alias(k) for k in ("code", "equipment", "imo")],
        )
        timed = values.withColumn("ts", F.when(~F.col("naive"), F.col("ts"))) if self.time_policy == "reject" else values
        within = lambda c, most: F.coalesce(F.abs(c) <= most, F.lit(False))
        slack = 0.00001 if self.era == CURRENT else 0.0
        year = F.year("ts")
        tested = timed.withColumns(
            {
                "mmsi_ok": valid_mmsi(F.col("mmsi")),
                "era_ok": year.between(2018, 2024) if self.era == LEGACY else year >= 2025,  # null without a time
                "lat_ok": within("lat", 90 - slack),
                "lon_ok": within("lon", 180 - slack),
                "speed_ok": F.coalesce(F.col("speed").between(0, MAX_SOG[self.era]), F.lit(False)),
                "odd_equipment": F.coalesce(~F.col("equipment").isin("A", "B"), F.lit(False)),
            }
        )
        reasons = F.array_compact(
            F.array(
                F.when(~F.col("mmsi_ok"), F.lit("invalid_mmsi")),
                F.when(F.col("era_ok").isNull(), F.lit("invalid_or_naive_timestamp")).when(~F.col("era_ok"), F.lit("timestamp_outside_source_era")),
                F.when(~F.col("lat_ok"), F.lit("invalid_lat")),
                F.when(~F.col("lon_ok"), F.lit("invalid_lon")),
            )
        )
        flags = F.array_compact(
            F.array(
                F.when(F.col("naive"), F.lit("source_dictionary_utc_assumed")),
                F.when(F.col("speed_text").isNull(), F.lit("missing_sog")).when(~F.col("speed_ok"), F.lit("invalid_or_sentinel_sog")),
                F.when(F.col("odd_equipment"), F.lit("unknown_equipment_class")),
            )
        )
        good = F.col("mmsi_ok") & F.coalesce("era_ok", F.lit(False)) & F.col("lat_ok") & F.col("lon_ok")
        judged = tested.withColumn("good", good)
        kept = {
            "timestamp": F.col("ts"), "longitude": F.col("lon"), "latitude": F.col("lat"), "sog_knots": F.when(F.col("speed_ok"), F.col("speed")),
            "raw_vessel_code": F.col("code"), "equipment_class": F.col("equipment"), "imo": F.col("imo"),
        }
        return judged.select(
            "raw",
            "mmsi",
            *[F.when(F.col("good"), v).alias(k) for k, v in kept.items()],
            F.when(F.col("good"), flags).otherwise(F.array().cast("array<string>")).alias("quality_flags"),
            reasons.alias("reasons"),
        )


def classify(code: Column, mapping: dict[str, str], version: str) -> Column:
    """The category that a reviewed mapping gives a raw code, else unknown."""
    if not version:
        raise ValueError("a mapping version is required")
    if not mapping:
        return F.lit("unknown")
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(table[code], F.lit("unknown"))

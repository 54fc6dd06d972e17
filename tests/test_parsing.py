import pytest
from pyspark.sql import functions as F

from wakeline.functions.parsing import CURRENT, HEADERS, LEGACY, Parser, check_headers, classify

GOOD = {
    CURRENT: dict(mmsi="000000001", base_date_time="2025-01-01T00:00:00Z", latitude="10", longitude="20", sog="0", vessel_type="999", transceiver="B"),
    LEGACY: dict(MMSI="000000001", BaseDateTime="2020-01-01T00:00:00Z", LAT="10", LON="20", SOG="0", VesselType="70", TransceiverClass="A"),
}


def parse(spark, changes, era=CURRENT, policy="reject"):
    rows = [[{**GOOD[era], **c}.get(h, "") for h in HEADERS[era]] for c in changes]
    raw = spark.createDataFrame([[i, *r] for i, r in enumerate(rows)], ", ".join(["i int", *(f"`{h}` string" for h in HEADERS[era])]))
    return [r.asDict() for r in Parser(era, policy).parse(raw).orderBy("raw.i").collect()]


def test_times(spark):
    good = ["2025-01-01T00:00:00Z", "2025-01-01 00:00:00.123456Z", "2025-01-01T01:00:00+01:00", "2025-06-01T12:00:00-23:59"]
    bad = [
        "2025-01-01T00:00:00", "2025-01-01T00:00Z", "2025-01-01T00:00:00.1234567Z", "2025-02-30T00:00:00Z", "2025-01-01T24:00:00Z",
        "2025-01-01T00:60:00Z", "2025-01-01T00:00:60Z", "2025-01-01  00:00:00Z", "2025-01-01\t00:00:00Z", "2025-01-01T00:00:00Z x",
        "2025-01-01T00:00:00+00:60", "2025-01-01T00:00:00+24:00", " 2025-01-01T00:00:00Z", "",
    ]
    rows = parse(spark, [{"base_date_time": t} for t in good + bad])
    assert [r["reasons"] for r in rows[: len(good)]] == [[]] * len(good)
    assert rows[2]["timestamp"] == rows[0]["timestamp"]
    assert all(r["reasons"] == ["invalid_or_naive_timestamp"] and r["timestamp"] is None for r in rows[len(good) :])


def test_naive_time_policy(spark):
    (r,) = parse(spark, [{"base_date_time": "2025-01-01T00:00:00"}], policy="dictionary_utc")
    assert r["reasons"] == [] and r["quality_flags"] == ["source_dictionary_utc_assumed"]
    with pytest.raises(ValueError):
        Parser(CURRENT, "guess")


def test_rejections(spark):
    cases = [
        ({"latitude": "91"}, ["invalid_lat"]), ({"longitude": "181"}, ["invalid_lon"]), ({"latitude": "NaN"}, ["invalid_lat"]),
        ({"latitude": "inf"}, ["invalid_lat"]), ({"longitude": ""}, ["invalid_lon"]), ({"latitude": "90"}, ["invalid_lat"]),
        ({"base_date_time": "2024-12-31T23:59:59Z"}, ["timestamp_outside_source_era"]), ({"mmsi": "1"}, ["invalid_mmsi"]),
        ({"mmsi": "1", "latitude": "x", "longitude": "1d"}, ["invalid_mmsi", "invalid_lat", "invalid_lon"]),
    ]
    rows = parse(spark, [c for c, _ in cases])
    assert [r["reasons"] for r in rows] == [e for _, e in cases]
    assert all(r["longitude"] is None and r["quality_flags"] == [] for r in rows)


def test_speed_and_equipment(spark):
    rows = parse(spark, [{"sog": s} for s in ("102.3", "-1", "NaN", "inf", "", "null", "bad", "1_0", "99.9", "0")] + [{"transceiver": "future"}])
    assert [r["sog_knots"] for r in rows[:10]] == [None] * 7 + [10.0, 99.9, 0.0]
    assert rows[0]["quality_flags"] == ["invalid_or_sentinel_sog"] and rows[4]["quality_flags"] == ["missing_sog"]
    assert rows[10]["equipment_class"] == "future" and rows[10]["quality_flags"] == ["unknown_equipment_class"]
    legacy = parse(spark, [{"SOG": "102.2"}, {"SOG": "102.3"}, {"MMSI": "\t000000001 "}], LEGACY)
    assert [r["sog_knots"] for r in legacy[:2]] == [102.2, None] and legacy[2]["mmsi"] == "000000001"


def test_headers_and_classes(spark):
    check_headers(list(reversed(HEADERS[LEGACY])), LEGACY)
    for bad in ([*HEADERS[LEGACY][:-1]], [*HEADERS[LEGACY], "MMSI"], HEADERS[CURRENT]):
        with pytest.raises(ValueError):
            check_headers(list(bad), LEGACY)
    df = spark.createDataFrame([("70",), ("999",), (None,)], "code string")
    assert [r[0] for r in df.select(classify(F.col("code"), {"70": "cargo"}, "v1")).collect()] == ["cargo", "unknown", "unknown"]
    with pytest.raises(ValueError):
        classify(F.col("code"), {}, "")


def test_empty_table(spark):
    assert parse(spark, []) == []

"""Adjacency, episodes and checkpoints of vessels cut into slices equal those of whole vessels."""

import datetime as dt
import random

from pyspark.sql import functions as F

from wakeline.functions.projection import LocalProjection
from wakeline.operators import tracks
from wakeline.plans import relation as rel

P = LocalProjection(20.0, 10.0, 50_000.0, 0.007)
T = dt.datetime(2025, 1, 1)
CONFIG = tracks.TrackConfig(1800, 90, T.replace(tzinfo=dt.timezone.utc), (T + dt.timedelta(hours=30)).replace(tzinfo=dt.timezone.utc))
SCHEMA = (
    "mmsi string, record_key string, timestamp timestamp, outcome string, scope string, signature string, longitude double, latitude double, "
    "sog_knots double, raw_vessel_code string, equipment_class string, imo string"
)


def event(rng, i, vessel, when):
    return (
        vessel, f"k{i:05d}", when, rng.choices(["accepted", "rejected", "filtered"], [20, 1, 1])[0], "core", rng.choice("xy"),
        20 + rng.uniform(0, 0.02), 10 + rng.uniform(0, 0.02), 5.0, "1", "A", rng.choice(["", "", "", "i1", "i2"]),
    )


def random_events(rng):
    out = []
    for vessel, n in (("100000001", 400), ("100000002", 60), ("100000003", 3), ("100000004", 150)):
        at = T
        for _ in range(n):
            at += dt.timedelta(seconds=rng.choice([0, 1, 60, 600, 4000]))
            out.append(event(rng, len(out), vessel, at))
    out += [event(rng, len(out) + i, "100000004", None) for i in range(120)]
    return out


def results(spark, events, carry):
    e = tracks.with_episodes(tracks.decided(tracks.adjacency(events, carry), CONFIG, P))
    rows = e.select(
        "mmsi", "record_key", "nth", "skip", "unknown_time", "carried_barrier", "carry_episode", F.col("prev.record_key").alias("left"),
        F.array_join("reasons", ",").alias("reasons"), "breaks", "episode_id", "episode_after",
    )
    return sorted(map(repr, rows.collect())), sorted(map(repr, tracks.checkpoint(e, CONFIG, carry).collect()))


def test_slices_change_nothing(spark):
    for seed in (1,):
        rng = random.Random(seed)
        rows = random_events(rng)
        events = spark.createDataFrame(rows, SCHEMA)
        held = [  # a repeat of the first event, a point before it, one after it, and a vessel that doesn't report
            (r[0], {**dict(zip(tracks.EVENT, r[1:])), "record_key": "carry", "timestamp": r[2] + dt.timedelta(seconds=s)}, b, "e1")
            for r, s, b in zip((rows[0], rows[400], rows[460]), (0, -90, 90), (False, True, True))
        ]
        held.append(("100000009", held[0][1], True, None))
        fields = SCHEMA.removeprefix("mmsi string, ")
        order = [f.split()[0] for f in fields.split(", ")]
        carry = spark.createDataFrame(
            [(m, tuple(p[k] for k in order), b, e) for m, p, b, e in held], f"mmsi string, point struct<{fields.replace(' ', ':').replace(',:', ',')}>, barrier_seen boolean, episode_id string"
        ).withColumn("point", F.struct(*[F.col(f"point.{c}") for c in tracks.EVENT]))
        for c in (None, carry):
            want = results(spark, events, c)
            for n, seconds in ((50, 600), (7, 1)):
                cut = tracks.sliced(events, n, seconds)
                assert cut.select("_slice").distinct().count() > 3
                assert results(spark, cut, c) == want
            assert results(spark, tracks.sliced(events, 10_000), c) == want


def test_slices_are_even_and_small_vessels_whole(spark):
    sf = "/root/testdata/sf0.001"
    e = rel.track_events(spark, sf)
    one = tracks.events_of(e.withColumn("mmsi", F.when(F.col("event_id") % 10 < 9, F.lit("200000000")).otherwise(F.lit("200000001"))))
    n = {(r.mmsi, r["_slice"]): r["count"] for r in tracks.sliced(one, 120, 3600).groupBy("mmsi", "_slice").count().collect()}
    large = sorted(v for (m, _), v in n.items() if m == "200000000")
    assert len(large) >= 6 and large[-1] < 2 * large[len(large) // 2]
    assert [k for k in n if k[0] == "200000001"] == [("200000001", 0)]


def test_nothing_to_slice(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert results(spark, tracks.sliced(empty), None) == ([], [])

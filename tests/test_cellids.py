"""Cell ids by shifts and masks against a reading digit by digit; exact vessel containers."""

import random

import pytest
from pyspark.sql import functions as F

from wakeline.functions import cellids
from wakeline.operators import metrics
from wakeline.operators.geometry import Tile, TileConfig
from wakeline.plans.grid import polygon, square
from wakeline.plans.relation import PROJECTION


def made(mode=1, spare=0, r=7, base=20, digits=(), rest=7):
    own = [*digits, *[0] * (r - len(digits)), *[rest] * (15 - r)]
    value = mode << 59 | spare << 56 | r << 52 | base << 45
    for i, d in enumerate(own):
        value |= d << 3 * (14 - i)
    return f"{value:x}"


CASES = [
    (made(), None), ("872830828ffffff", None), ("8928308280fffff", "resolution"), (made(base=121), None), (made(base=122), "base_cell"), (made(base=127), "base_cell"),
    (made(digits=[7]), "digits"), (made(digits=[0, 0, 0, 0, 0, 0, 7]), "digits"), (made(rest=6), "digits"), (made(r=0), "resolution"), (made(r=15), "resolution"),
    (made(base=4, digits=[0, 1]), "pentagon"), (made(base=4, digits=[0, 2, 1]), None), (made(base=4), None), (made(base=117, digits=[0] * 6 + [1]), "pentagon"),
    (made(base=5, digits=[1]), None), (made(mode=2), "mode"), (made(mode=15), "mode"), (made(spare=3), "mode"), ("1", "mode"), ("ffffffffffffffff", "mode"),
    (made().upper(), "not_canonical"), ("0" + made(), "not_canonical"), ("0x" + made(), "not_canonical"), (made() + "\n", "not_canonical"), ("", "not_canonical"),
    ("8" * 17, "not_canonical"), ("8g2830828ffffff", "not_canonical"), (None, "not_canonical"),
]


def test_faults(spark):
    rng = random.Random(3)
    ids = [c for c, _ in CASES] + [f"{rng.getrandbits(60) | 8 << 56 & ~(15 << 56):x}" for _ in range(200)]
    ids += [made(r=7, base=rng.choice([4, 20, 107]), digits=[rng.choice([0, 0, 1, 2, 7 if rng.random() < 0.1 else 3]) for _ in range(7)]) for _ in range(300)]
    got = spark.createDataFrame([(c,) for c in ids], "cell string").select("cell", cellids.fault(F.col("cell"), 7).alias("fault")).collect()
    for row, want in zip(got, [w for _, w in CASES]):
        assert row.fault == want, row
    for row in got:
        assert row.fault == (cellids.fault_of(row.cell, 7) if row.cell is not None else "not_canonical"), row


def test_parents(spark):
    v = cellids.bits(F.col("cell"))
    row = spark.createDataFrame([("8928308280fffff",)], "cell string").select(*[cellids.text(cellids.parent(v, F.lit(r))).alias(f"p{r}") for r in (10, 9, 7, 0)]).first()
    assert (row.p10, row.p9, row.p7, row.p0) == (None, "8928308280fffff", "872830828ffffff", "8029fffffffffff")


def test_tile_of_published_ids():
    area = polygon(-100, -100, 200)
    for name, good in ((made(), True), (made(r=8), False), ("a", False)):
        build = lambda: Tile(TileConfig(PROJECTION, 7, published_ids=True), area, {"type": "MultiPolygon", "coordinates": []}, area, [(name, square(-500, -500, 1000))])
        if good:
            build()
        else:
            with pytest.raises(ValueError):
                build()


def test_vessel_containers(spark, monkeypatch):
    """Lists and bitmaps, several buckets, chained numbers, repeated rows, rows without a cell or vessel, no rows."""
    monkeypatch.setattr(metrics, "LISTED", 20)
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", "c", None]), f"2025-01-{rng.randint(1, 28):02d} 10:00:00", f"{rng.randint(1, 300):09d}" if rng.random() < 0.99 else None) for _ in range(4000)]
    points = spark.createDataFrame(rows, "cell string, t string, mmsi string").withColumn("timestamp", F.col("t").cast("timestamp"))
    early = metrics.vessel_numbers(points.filter("timestamp < '2025-01-02'")).cache()
    numbers = metrics.vessel_numbers(points, early).cache()
    found = {r.mmsi: r.number for r in numbers.collect()}
    assert sorted(found.values()) == list(range(1, len({m for _, _, m in rows if m}) + 1))
    assert all(found[r.mmsi] == r.number for r in early.collect())
    apart = numbers.withColumn("number", F.col("number") * 1000)  # into many buckets
    for n in (numbers, apart):
        days = metrics.vessel_bitmaps(points, n).cache()
        kinds = days.agg(F.count("listed").alias("listed"), F.count("bits").alias("bits")).first()
        assert kinds.listed and (kinds.bits or n is apart)
        for unit in ("day", "month"):
            got = {(r.cell, r.window_start): r.unique_observed_vessels for r in metrics.vessels_of_windows(days, F.date_trunc(unit, "utc_date")).collect()}
            p = points.filter("cell IS NOT NULL AND mmsi IS NOT NULL").groupBy("cell", F.date_trunc(unit, F.to_date("timestamp")).alias("w")).agg(F.count_distinct("mmsi").alias("n"))
            assert got == {(r.cell, r.w): r.n for r in p.collect()}
    nothing = points.limit(0)
    assert metrics.vessels_of_windows(metrics.vessel_bitmaps(nothing, metrics.vessel_numbers(nothing)), F.col("utc_date")).count() == 0

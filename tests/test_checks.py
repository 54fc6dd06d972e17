"""Checks of single contributions and of an export's spatial settings."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wakeline.operators import allocate, metrics

T = dt.datetime(2025, 1, 1)


def test_contribution_faults(spark):
    minute = T + dt.timedelta(minutes=1)
    rows = [
        ("ok", "1", T, minute, 1.0, 60.0, 600.0),
        ("ok2", "1", T, minute, 0.0, 0.0, None),
        ("empty", "1", T, T, 1.0, 0.0, None),
        ("nobody", None, T, minute, 1.0, 0.0, None),
        ("negative", "1", T, minute, -1.0, 0.0, None),
        ("nan", "1", T, minute, float("nan"), 0.0, None),
        ("infinite", "1", T, minute, 1.0, 60.0, float("inf")),
        ("null", "1", T, minute, None, 0.0, None),
        ("long", "1", T, minute, 1.0, 61.0, 1.0),
        ("lone", "1", T, minute, 1.0, 30.0, None),
        ("reverse", "1", T, minute, 1.0, 0.0, 5.0),
    ]
    df = spark.createDataFrame(
        rows,
        "interval_id string, mmsi string, start timestamp, end timestamp, distance_km double, speed_supported_seconds double, "
        "reported_sog_integral_knot_seconds double",
    )
    got = {r.interval_id: r.fault for r in allocate.contribution_faults(df).collect()}
    assert got == {
        "empty": "no_duration", "nobody": "no_identity", "negative": "bad_amount", "nan": "bad_amount", "infinite": "bad_amount",
        "null": "bad_amount", "long": "support_longer_than_part", "lone": "support_without_integral_or_reverse",
        "reverse": "support_without_integral_or_reverse",
    }
    assert allocate.contribution_faults(df.limit(0)).count() == 0


def test_spatial_selection():
    metrics.spatial_selection(domain="bay", geometry_version="1", resolution=0)
    with pytest.raises(ValueError, match="geometry_version, resolution"):
        metrics.spatial_selection(domain="bay", geometry_version="")


def test_value_faults(spark):
    """Each rule of an export's values, and values that metric_value makes, which break none."""
    inf, nan = float("inf"), float("nan")
    cases = [
        ((1.0, "observed", None, 1.0, 1.0), None), ((None, "observed", None, 1.0, 1.0), "observed_without_value"), ((0.0, "unknown", "r", None, None), "unsupported_not_null"),
        ((None, "unknown", "r", None, None), None), ((None, "unknown", "", None, None), "no_reason"), ((None, "unavailable", None, 0.0, 1.0), "no_reason"),
        ((1.0, "partial", "r", 1.0, 2.0), None), ((1.0, "partial", "r", None, 2.0), "partial_without_support"), ((1.0, "partial", "r", 0.0, 2.0), "partial_without_support"),
        ((None, "partial", "r", None, None), None), ((1.0, "observed", None, 3.0, 2.0), "available_exceeds_expected"), ((1.0, "observed", None, nan, 2.0), "coverage_not_finite"),
        ((1.0, "observed", None, 1.0, inf), "coverage_not_finite"), ((-1.0, "observed", None, 1.0, 1.0), "value_not_finite"), ((nan, "observed", None, 1.0, 1.0), "value_not_finite"),
        ((1.0, "fine", None, 1.0, 1.0), "unknown_status"), ((1.0, None, None, 1.0, 1.0), "unknown_status"),
    ]
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, value double, status string, reason string, a double, e double")
    support = metrics.coverage("d", "s", ["e"], F.col("a"), F.col("e"))
    m = F.struct("value", "status", "reason", support.alias("coverage"))
    got = {r.i: r.fault for r in df.select("i", metrics.value_fault(m).alias("fault")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}
    sound = df.filter("coalesce(a <= e AND NOT isnan(a) AND e < double('inf') AND value >= 0 AND NOT isnan(value), true)")
    made = sound.select(metrics.metric_value(F.col("value"), "m", support).alias("m")).select("m", metrics.value_fault(F.col("m")).alias("fault")).collect()
    assert made and all(r.fault is None for r in made)
    for settings in (dict(domain="d"), dict(domain="d", geometry_version="1", resolution=None)):
        with pytest.raises(ValueError):
            metrics.daily_exports(df, "v", "m", ["s"], **settings)
    with pytest.raises(ValueError):
        metrics.coverage("d", "s", [], F.col("a"), F.col("e"))


@pytest.mark.parametrize("name", ["ledger_rollup", "conservation"])
def test_intervals_are_made_once(spark, name):
    """Intervals go with their parts, so none is made again to be joined to its own sums."""
    from wakeline.plans.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("Window [lag(_w0") == 1 and "Join" not in plan


def ledger_of(spark, rows):
    """Accepted intervals along x in metres, 100 s each: id, to, and whether their clip has a gap."""
    row = "interval_id string, mmsi string, right_record_key string, outcome string, start timestamp, end timestamp, seconds double, length_m double, x1 double, y1 double, x2 double, y2 double"
    at = dt.datetime(2024, 1, 1, 23, 59)
    return spark.createDataFrame([(k, "1", "r" + k, "accepted_estimate", at, at + dt.timedelta(seconds=100), 100.0, x, 0.0, 0.0, x, 0.0) for k, x in rows], row)


def test_rolled_up_rows_equal_a_direct_sum(spark):
    part = lambda lo, hi, cell: F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(cell).cast("string").alias("cell"))
    clip = lambda x1, y1, x2, y2: F.array(part(0.0, 0.25, "a"), part(0.25, 0.5, None), part(0.5, 1.0, "b"))
    i, core = ledger_of(spark, [("i", 1000.0), ("j", 0.0)]), (dt.datetime(2023, 1, 1), dt.datetime(2025, 1, 1))
    r = allocate.conserved(allocate.rolled_up_rows(allocate.pieces(allocate.cut(i, *core, clip)), *core), 1e-6, 1e-6)
    got = {x.interval_id: (x.inside_seconds, x.outside_seconds, round(x.inside_km, 9), round(x.outside_km, 9), x.owned_seconds) for x in r.collect()}
    assert got == {"i": (75.0, 25.0, 0.75, 0.25, 100.0), "j": (75.0, 25.0, 0.0, 0.0, 100.0)}
    for lost in (lambda *e: F.slice(clip(*e), 1, 2), lambda *e: F.slice(clip(*e), 1, 0)):
        with pytest.raises(Exception, match="allocation isn't conserved"):
            allocate.conserved(allocate.rolled_up_rows(allocate.pieces(allocate.cut(i, *core, lost)), *core), 1e-6, 1e-6).collect()


def test_conservation_faults(spark):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    names = ["whole", "none", "vessel", "gap", "overlap", "short", "variants", "far"]
    i = spark.createDataFrame([(n, "1", t(0), t(10), 2.0) for n in names], "interval_id string, mmsi string, start timestamp, end timestamp, distance_km double")
    parts = {
        "whole": [(6, 10), (0, 6)], "vessel": [(0, 6, "2"), (6, 10)], "gap": [(0, 5), (6, 10)], "overlap": [(0, 7), (6, 10)],
        "short": [(0, 6), (6, 9)], "variants": [(0, 6), (6, 10, "1", "w")], "far": [(0, 6), (6, 10, "1", "v", 3.0)],
    }
    full = lambda a, b, mmsi="1", variant="v", km=1.0: (mmsi, t(a), t(b), km, variant)
    p = spark.createDataFrame([(n, *full(*x)) for n, ps in parts.items() for x in ps], "interval_id string, mmsi string, start timestamp, end timestamp, distance_km double, variant string")
    got = {r.interval_id: r.fault for r in allocate.conservation_faults(i, p, 1e-3, 1e-3).collect()}
    assert got == {
        "none": "no_parts", "vessel": "parent_or_identity_mismatch", "gap": "overlap_or_gap", "overlap": "overlap_or_gap",
        "short": "not_one_covering_variant", "variants": "not_one_covering_variant", "far": "distance_not_conserved",
    }

"""Ingestion and trajectories end to end on small files."""

import hashlib
import json
from datetime import datetime, timedelta, timezone

import pytest
import zstandard
from pyspark.sql import functions as F

from wakeline import cli
from wakeline.functions.parsing import CURRENT, HEADERS
from wakeline.functions.projection import LocalProjection
from wakeline.operators import reconcile, tracks
from wakeline.operators.geometry import Tile, TileConfig
from wakeline.operators.reconcile import SpatialFilter, TimeWindow
from wakeline.plans import ingest, jobs, trajectories
from wakeline.plans.grid import geographic
from wakeline.sources.catalog import SourcePartition
from wakeline.sources.rawtext import read_positions

T0 = datetime(2025, 1, 1, tzinfo=timezone.utc)


def line(t, lat=10.0, lon=20.0, mmsi="000000001", **more):
    row = dict(mmsi=mmsi, base_date_time=t if isinstance(t, str) else t.strftime("%Y-%m-%dT%H:%M:%S.%fZ"), latitude=lat, longitude=lon, sog=0, transceiver="B") | more
    return ",".join(str(row.get(h, "")) for h in HEADERS[CURRENT])


def write(path, lines):
    data = ("\n".join([",".join(HEADERS[CURRENT]), *lines]) + "\n").encode()
    path.write_bytes(zstandard.compress(data) if path.suffix == ".zst" else data)
    return path


def source(path, start=T0 - timedelta(days=1), end=T0 + timedelta(days=3), **more):
    r = dict(
        provider="noaa_marinecadastre", asset_id=path.name, sha256=hashlib.sha256(path.read_bytes()).hexdigest(), acquired_at=T0, start=start,
        end=end, source_era=CURRENT, schema_verified=True, rights_evidence="r", coverage_evidence="c", availability="available",
    )
    return str(path), SourcePartition(**(r | more))


def config(core=T0, days=1, **caps):
    end = core + timedelta(days=days)
    minute = timedelta(minutes=1)
    c = dict(max_records=1000, max_decoded_bytes=1 << 20, max_record_characters=4000, zstd_window_kib=8192) | caps
    return ingest.IngestConfig(
        "p", TimeWindow(core, end, core - minute, end + minute), SpatialFilter("box", 19, 9, 21, 11, 0.1), "reject", producer_git_sha="a" * 40, **c
    )


def counts(path):
    return json.loads((path / "complete.json").read_text())["counts"]


def test_two_files_reconcile_in_any_order(spark, tmp_path):
    s = timedelta(seconds=1)
    a = write(tmp_path / "a.csv", [line(T0), line(T0 + 60 * s), line(T0 + 120 * s, lon=20.1)])
    b = write(tmp_path / "b.csv.zst", [line(T0), line(T0 + 120 * s, lon=20.2), line(T0, lat=91), line(T0 + 180 * s, lon=25)])
    out = ingest.ingest(spark, [source(a), source(b)], config(), tmp_path / "runs")
    assert counts(out) == {"accepted": 2, "duplicate": 1, "filtered": 1, "rejected": 3}
    again = ingest.ingest(spark, [source(b), source(a)], config(), tmp_path / "runs")
    assert again == out
    state = spark.read.parquet(str(out / "state")).first()
    assert state.barrier_seen and state.point.record_key == "a.csv:00000000000000000003"
    next(out.glob("audit/*.parquet")).write_bytes(b"changed")
    with pytest.raises(ValueError):
        ingest.ingest(spark, [source(a), source(b)], config(), tmp_path / "runs")


def test_lines_are_physical(spark, tmp_path):
    p = write(tmp_path / "q.csv", [line(T0, vessel_name='"two\nlines"'), "", line(T0)])
    rows = read_positions(spark, CURRENT, [dict(path=str(p), asset_id="q")]).collect()
    assert [(r.row_start, r.row_end) for r in rows] == [(2, 3), (5, 5)]


@pytest.mark.parametrize("fault", ["cut", "trailing", "frames", "width", "quote", "empty", "cap", "sha", "header"])
def test_faults_leave_no_complete_run(spark, tmp_path, fault):
    name = "f.csv.zst" if fault in ("cut", "trailing", "frames") else "f.csv"
    p = write(tmp_path / name, [] if fault == "empty" else [line(T0), line(T0 + timedelta(seconds=9))])
    data = p.read_bytes()
    change = {
        "cut": data[:-5], "trailing": data + b"x", "frames": data + data, "width": data + b"a,b\n", "quote": data + b'"open,',
        "header": data.replace(b"mmsi", b"MMSI", 1),
    }
    p.write_bytes(change.get(fault, data))
    item = source(p, sha256="0" * 64) if fault == "sha" else source(p)
    with pytest.raises(Exception):
        ingest.ingest(spark, [item], config(**({"max_decoded_bytes": 10} if fault == "cap" else {})), tmp_path / "runs")
    assert not list(tmp_path.glob("runs/*/complete.json")) and list(tmp_path.glob("runs/.stage*/failure.json"))


def test_carried_endpoint(spark, tmp_path):
    end = T0 + timedelta(days=1)
    a = write(tmp_path / "a.csv", [line(end - timedelta(seconds=30))])
    first = ingest.ingest(spark, [source(a)], config(), tmp_path / "runs")
    for lon, want in ((20.0, {"accepted": 2}), (20.05, {"accepted": 1, "rejected": 1})):
        b = write(tmp_path / f"b{lon}.csv", [line(end - timedelta(seconds=30), lon=lon), line(end + timedelta(seconds=30))])
        second = ingest.ingest(spark, [source(b)], config(end), tmp_path / "runs", carried=first)
        assert counts(second) == want
        state = spark.read.parquet(str(second / "state")).first()
        assert state.barrier_seen == (lon != 20.0)
    with pytest.raises(ValueError):
        ingest.ingest(spark, [source(a)], config(end + timedelta(days=1)), tmp_path / "runs", carried=first)


P = LocalProjection(20.0, 10.0, 50_000.0, 0.007)


def square(x0, y0, x1, y1):
    return [geographic(*p) for p in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]


def tile(land=None):
    box = lambda *b: {"type": "Polygon", "coordinates": [square(*b)]}
    land = land or {"type": "MultiPolygon", "coordinates": []}
    cells = [("a", square(-3000, -3000, 0, 3000)), ("b", square(0, -3000, 3000, 3000))]
    return Tile(TileConfig(P, 7), box(-2000, -2000, 2000, 2000), land, box(-10_000, -10_000, 10_000, 10_000), cells)


def track(days=1, core=T0, **more):
    c = dict(max_gap_seconds=600.0, max_implied_speed_knots=90.0) | more
    return trajectories.TrajectoryConfig(tracks.TrackConfig(core_start=core, core_end=core + timedelta(days=days), **c), tile().config, 10_000)


def at(x, y, seconds, outcome="accepted", mmsi="000000001", sog=None, start=T0, timed=True):
    lon, lat = geographic(x, y)
    t = start + timedelta(seconds=seconds)
    return (mmsi, f"k{mmsi}:{seconds:09.3f}", t if timed else None, outcome, "core" if outcome == "accepted" else "outside", f"{x},{y},{sog}", lon, lat, sog, "70", "A", None)


AUDIT = "mmsi string, record_key string, timestamp timestamp, outcome string, scope string, signature string, longitude double, latitude double, sog_knots double, raw_vessel_code string, equipment_class string, imo string"


def run(spark, rows, config=None, the_tile=None, carry=None):
    return trajectories.estimate(spark.createDataFrame(rows, AUDIT), the_tile or tile(), config or track(), carry)


def reasons(tables):
    return [(r.outcome, r.reasons) for r in tables.intervals.orderBy("mmsi", "end").collect()]


def test_straight_route_is_conserved(spark):
    t = run(spark, [at(-4000, 0, 0, sog=2.0), at(4000, 0, 600, sog=6.0)])
    r = t.intervals.first()
    assert r.distance_km == pytest.approx(8, abs=1e-6) and r.inside_km == pytest.approx(4, abs=1e-6)
    assert r.inside_seconds == pytest.approx(300, abs=1e-5) and r.outside_seconds == pytest.approx(300, abs=1e-5)
    total = t.contributions.agg(F.sum("reported_sog_integral_knot_seconds"), F.sum("seconds")).first()
    assert total[0] == pytest.approx(2400, abs=1e-3) and total[1] == pytest.approx(600, abs=1e-5)


def test_gaps_and_barriers(spark):
    assert reasons(run(spark, [at(0, 0, 0), at(1, 0, 600), at(2, 0, 1201)])) == [("accepted_estimate", []), ("rejected", ["excessive_gap"])]
    filtered = run(spark, [at(0, 0, 0), at(1, 0, 60), at(900, 0, 90, "filtered"), at(2, 0, 120), at(3, 0, 180)])
    assert [o for o, _ in reasons(filtered)] == ["accepted_estimate", "rejected", "rejected", "accepted_estimate"]
    untimed = run(spark, [at(0, 0, 0), at(1, 0, 60), at(2, 0, 90, "rejected", timed=False)])
    assert all(o == "rejected" for o, _ in reasons(untimed)) and untimed.contributions.count() == 0
    fast = run(spark, [at(-2000, 0, 0), at(2000, 0, 60)])
    assert reasons(fast) == [("rejected", ["implied_speed_jump_or_threshold_uncertainty"])]


def test_land(spark):
    strip = {"type": "Polygon", "coordinates": [square(-50, -500, 50, 500)]}
    assert reasons(run(spark, [at(-900, 0, 0), at(900, 0, 300)], the_tile=tile(strip))) == [("rejected", ["material_land_crossing"])]
    assert reasons(run(spark, [at(-900, 501, 0), at(900, 501, 300)], the_tile=tile(strip))) == [("rejected", ["shoreline_uncertainty"])]


def test_two_days_equal_one_run_of_both(spark):
    rows = [at(-100 + i, 0, 86_400 - 300 + 60 * i, sog=1.0) for i in range(12)] + [at(i, 50, 86_400 - 200 + 50 * i, mmsi="000000002") for i in range(9)]
    whole = run(spark, rows, track(2))
    key = ["mmsi", "left_record_key", "right_record_key", "utc_date", "cell"]
    total = lambda ts: sorted((*[r[k] for k in key], round(r.s, 5), round(r.km, 7)) for t in ts for r in t.groupBy(*key).agg(F.sum("seconds").alias("s"), F.sum("distance_km").alias("km")).collect())
    cut = T0 + timedelta(days=1)
    first_rows = [r for r in rows if r[2] <= cut + timedelta(seconds=60)]
    first = run(spark, first_rows, track(1))
    later = [r for r in rows if r[2] >= cut]
    second = run(spark, later, track(1, cut), carry=first.state)
    assert total([whole.contributions]) == total([first.contributions, second.contributions])
    merged = {r.mmsi: r for r in second.state.collect()}
    for r in whole.state.collect():
        assert (r.point.record_key, r.barrier_seen, r.episode_id) == (merged[r.mmsi].point.record_key, merged[r.mmsi].barrier_seen, merged[r.mmsi].episode_id)


def test_repeat_of_carried_endpoint_is_no_leg(spark):
    first = run(spark, [at(0, 0, 0), at(5, 0, 86_390)], track(1, max_gap_seconds=1e6))
    second = run(spark, [at(5, 0, 86_390), at(9, 0, 86_450)], track(1, T0 + timedelta(days=1), max_gap_seconds=1e6), carry=first.state)
    assert [(r.left_record_key[-9:], r.outcome) for r in second.intervals.collect()] == [("86390.000", "accepted_estimate")]


def test_empty_window(spark):
    t = run(spark, [])
    assert t.intervals.count() == t.contributions.count() == t.points.count() == t.state.count() == 0


def test_run_from_ingestion(spark, tmp_path):
    a = write(tmp_path / "a.csv", [line(T0 + timedelta(seconds=60 * i), lat=10.0, lon=20 + 0.001 * i, sog=3) for i in range(5)])
    run1 = ingest.ingest(spark, [source(a)], config(), tmp_path / "runs")
    out = trajectories.run(spark, run1, tile(), track(), tmp_path / "tracks")
    assert counts(out) == {"accepted_estimate": 4}
    assert trajectories.run(spark, run1, tile(), track(), tmp_path / "tracks") == out
    assert sorted(p.name for p in out.iterdir() if p.is_dir()) == sorted(trajectories.ARTIFACTS)
    points = spark.read.parquet(str(out / "points"))
    assert points.count() == 5 and points.filter("cell_status = 'observed_point'").count() == 5


def test_core_and_carry_must_fit(spark):
    c = track()
    at = lambda d: {"core_start": (c.track.core_start + d).isoformat(), "core_end": (c.track.core_end + d).isoformat()}
    day, none = c.track.core_end - c.track.core_start, timedelta(0)
    policy = c.policy(tile())
    trajectories.require_core(c, at(none), None, None, policy)
    trajectories.require_core(c, at(none), at(-day), at(-day) | {"policy_hash": policy}, policy)
    for bad in ((at(day), None, None), (at(none), at(none), None), (at(none), at(-day), at(-2 * day) | {"policy_hash": policy}), (at(none), at(-day), at(-day) | {"policy_hash": "x"})):
        with pytest.raises(ValueError):
            trajectories.require_core(c, *bad, policy)


def test_shared_folder_and_changed_inputs(spark, tmp_path, monkeypatch):
    jobs.require_shared(spark, tmp_path)
    assert not list(tmp_path.iterdir())
    a = write(tmp_path / "a.csv", [line(T0)])
    monkeypatch.setattr(jobs, "digests_of", lambda spark, paths: dict.fromkeys(paths, "0" * 64))
    with pytest.raises(ValueError, match="changed"):
        ingest.ingest(spark, [source(a)], config(), tmp_path / "runs")
    assert not [p for p in (tmp_path / "runs").iterdir() if (p / "complete.json").exists()]


def test_audit_outcomes(spark):
    audit = spark.createDataFrame([("accepted",), ("accepted",), ("rejected",)], "outcome string")
    trajectories.checked_outcomes(audit, {"accepted": 2, "rejected": 1})
    for bad, counts_ in ((audit, {"accepted": 2}), (audit.selectExpr("'else' AS outcome"), {"else": 3}), (audit.selectExpr("CAST(NULL AS STRING) AS outcome"), {})):
        with pytest.raises(ValueError):
            trajectories.checked_outcomes(bad, counts_)


def test_rows_without_time_are_dealt_out(spark):
    rows = spark.range(4000).selectExpr("CAST(id AS STRING) AS record_key", "'' AS mmsi", "CAST(NULL AS TIMESTAMP) AS timestamp")
    sizes = [r["n"] for r in reconcile.dealt(rows).groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 4000 and (len(sizes) == 1 or max(sizes) < 2500)


def test_command_line(spark, tmp_path, capsys):
    p = write(tmp_path / "v.csv", [line(T0), line(T0 + timedelta(seconds=60), sog="")])
    assert cli.main(["validate-csv", str(p), "--era", CURRENT]) == 0
    assert json.loads(capsys.readouterr().out)["accepted"] == 2
    write(p, [line(T0), line("bad")])
    assert cli.main(["validate-csv", str(p), "--era", CURRENT]) == 1
    p.write_text("a,b\n1,2\n")
    assert cli.main(["validate-csv", str(p), "--era", CURRENT]) == 2
    assert cli.main(["inspect-metrics"]) == 0 and cli.main(["inspect-catalog"]) == 0


def test_strict_jobs(tmp_path):
    for text in ('{"a": 1, "a": 2}', '{"a": NaN}'):
        (tmp_path / "j.json").write_text(text)
        with pytest.raises(ValueError):
            jobs.strict_json(tmp_path / "j.json")
    with pytest.raises(ValueError):
        jobs.exact_keys({"a": 1}, {"b"})

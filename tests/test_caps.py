"""Caps and counts that are taken while tables are written."""

import json
from dataclasses import replace
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from test_plans import T0, config, counts, line, source, tile, track, write

from wakeline.plans import ingest, jobs, trajectories


def data_files(root):
    return [p for p in root.rglob("*") if p.is_file() and p.name != "failure.json"]


def many(n, first=0):
    return [line(T0 + timedelta(seconds=60 * (first + i)), lon=20 + (first + i) / 10_000) for i in range(n)]


def test_records_over_the_cap_leave_no_data(spark, tmp_path):
    """Each file is within the cap, both together aren't."""
    a, b = write(tmp_path / "a.csv", many(30)), write(tmp_path / "b.csv", many(30, 100))
    with pytest.raises(Exception, match="records"):
        ingest.ingest(spark, [source(a), source(b)], config(max_records=59), tmp_path / "runs")
    assert not data_files(tmp_path / "runs")
    note = json.loads(next((tmp_path / "runs").glob(".stage*/failure.json")).read_text())
    assert note["status"] == "failed"
    out = ingest.ingest(spark, [source(a), source(b)], config(max_records=60), tmp_path / "runs")
    receipt = json.loads((out / "complete.json").read_text())
    audit = spark.read.parquet(str(out / "audit"))
    assert receipt["input_rows"] == audit.count() == 60
    assert counts(out) == {r.outcome: r["count"] for r in audit.groupBy("outcome").count().collect()}


def test_contributions_over_the_cap_leave_no_data(spark, tmp_path):
    a = write(tmp_path / "a.csv", many(20))
    run = ingest.ingest(spark, [source(a)], config(), tmp_path / "runs")
    with pytest.raises(Exception, match="contributions"):
        trajectories.run(spark, run, tile(), replace(track(), max_contributions=3), tmp_path / "estimates")
    assert not data_files(tmp_path / "estimates")
    assert trajectories.run(spark, run, tile(), track(), tmp_path / "estimates").name


@pytest.mark.parametrize("parts", [1, 5])
def test_written_within(spark, tmp_path, parts):
    df = spark.range(0, 100, 1, parts).withColumn("odd", F.col("id") % 2 == 1)
    seen = jobs.written_within(df, tmp_path / "t", 100, "rows", odd=F.count_if("odd"))
    assert seen == {"rows": 100, "odd": 50} and spark.read.parquet(str(tmp_path / "t")).columns == ["id", "odd"]
    for most in (99, 15, 0):
        with pytest.raises(Exception, match=f"more than {most}"):
            jobs.written_within(df, tmp_path / f"t{most}", most, "rows")


def test_written_within_no_rows(spark, tmp_path):
    for i, df in enumerate((spark.range(0), spark.range(10).filter("id > 20"), spark.range(10).filter("false").repartition("id"))):
        assert jobs.written_within(df, tmp_path / f"t{i}", 0, "rows", odd=F.count_if(F.col("id") > 0)) == {"rows": 0, "odd": 0}


def test_settings_that_are_refused():
    nan = float("nan")
    for wrong in (dict(max_contributions=0), dict(max_contributions=True), dict(seconds_tolerance=nan), dict(km_tolerance=-1.0), dict(km_tolerance=float("inf"))):
        with pytest.raises(ValueError):
            replace(track(), **wrong)

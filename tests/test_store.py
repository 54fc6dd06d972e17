"""Publication of runs: attempts, pointers, readers that only see what is published, roots by URI."""

import json
import threading
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from test_plans import T0, config, line, source, tile, track, write

from wakeline.plans import ingest, jobs, store, trajectories

KEY = "a" * 64


def receipt(**more):
    return {"method": "m", "run_key": KEY, "artifacts": {"t": "x"}} | more


def attempt(spark, root, rows=10):
    stage = store.begin(store.Folder(spark, root), KEY)
    jobs.save(spark.range(rows), stage / "t")
    return stage


def test_first_pointer_wins_and_the_other_writer_uses_it(spark, tmp_path):
    root = tmp_path / "with space"
    one, two = attempt(spark, root), attempt(spark, root, 20)
    for stage in (one, two):  # nothing is published before a pointer names it
        with pytest.raises(ValueError, match="complete"):
            jobs.verified_receipt(spark, root / stage.name, "m", {"t"})
    assert jobs.publish(two, receipt()) == two.name and jobs.publish(one, receipt()) == two.name
    assert not one.has() and spark.read.parquet(two / "t").count() == 20
    assert sorted(p.name for p in root.iterdir()) == sorted([two.name, f"{KEY}.json"])
    assert jobs.verified_receipt(spark, root / two.name, "m", {"t"})["files"]
    assert all(p.stat().st_mode & 0o077 == 0 for p in [root / two.name, *(root / two.name).rglob("*")])


def test_pointers_put_at_once(spark, tmp_path):
    """Many writers at one moment: one of them succeeds, and the file is whole."""
    root, won, ready = store.Folder(spark, tmp_path), [], threading.Barrier(8)

    def put(i):
        ready.wait()
        if root.put_if_absent("p.json", json.dumps({"attempt": str(i) * 1000})):
            won.append(i)

    threads = [threading.Thread(target=put, args=(i,)) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and json.loads(root.read("p.json"))["attempt"] == str(won[0]) * 1000
    assert [p.name for p in tmp_path.iterdir()] == ["p.json"]


def test_a_rename_decides_where_there_are_no_links(spark, tmp_path):
    """What other file systems than local ones do, here over the local one."""
    root = store.Folder(spark, tmp_path)
    root.local = False
    assert root.put_if_absent("p", "one") and not root.put_if_absent("p", "two")
    assert root.read("p") == "one" and [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["p"]


@pytest.mark.parametrize("change", ["bytes", "gone", "more", "method", "key", "pointer", "artifacts"])
def test_what_readers_refuse(spark, tmp_path, change):
    stage = attempt(spark, tmp_path)
    jobs.publish(stage, receipt())
    directory = tmp_path / stage.name
    file = next((directory / "t").glob("*.parquet"))
    if change == "bytes":
        file.write_bytes(b"changed")
    elif change == "gone":
        file.unlink()
    elif change == "more":
        spark.range(3).write.mode("append").parquet(str(directory / "t"))
    elif change == "pointer":
        (tmp_path / f"{KEY}.json").write_text(json.dumps({"attempt": "../elsewhere"}))
    elif change == "key":
        directory = directory.rename(tmp_path / directory.name.replace("a", "b", 64))
    method, artifacts = "n" if change == "method" else "m", {"t", "u"} if change == "artifacts" else {"t"}
    with pytest.raises(ValueError):
        jobs.verified_receipt(spark, directory, method, artifacts)


def test_a_task_that_fails_half_way(spark, tmp_path):
    """Tasks that ended have written their files; none is left, none was ever visible, and the next try is whole."""
    root = store.Folder(spark, tmp_path)
    stage = store.begin(root, KEY)
    fault = F.when(F.col("id") == 95, F.raise_error(F.lit("half-way")).cast("long")).otherwise(F.col("id"))
    with pytest.raises(Exception, match="half-way") as raised:
        jobs.save(spark.range(0, 100, 1, 20).select(fault.alias("id")), stage / "t")
    stage.fail(raised.value)
    assert store.pointed(root, KEY) is None and not list(tmp_path.rglob("*.parquet"))
    assert json.loads((tmp_path / f".stage-{KEY}" / "failure.json").read_text())["status"] == "failed"
    again = attempt(spark, tmp_path)
    assert jobs.publish(again, receipt()) == again.name and not (tmp_path / f".stage-{KEY}").exists()


def test_cut_off_attempts_are_swept(spark, tmp_path):
    lost, stage = attempt(spark, tmp_path), attempt(spark, tmp_path)
    jobs.publish(stage, receipt())
    (tmp_path / "other").mkdir()
    root = store.Folder(spark, tmp_path)
    assert store.swept(root, 3_600_000) == [] and store.swept(root, 0) == [lost.name]
    assert jobs.verified_receipt(spark, tmp_path / stage.name, "m", {"t"}) and (tmp_path / "other").exists()


def test_runs_below_a_uri(spark, tmp_path):
    """Both runs with roots, inputs and carried runs named by URI; the same runs as by local paths."""
    end, uri = T0 + timedelta(days=1), tmp_path.resolve().as_uri()
    a = write(tmp_path / "a.csv", [line(end - timedelta(seconds=60 * i), lon=20 + 0.001 * i, sog=3) for i in range(4)])
    b = write(tmp_path / "b.csv", [line(end + timedelta(seconds=60 * i), lon=20 - 0.001 * i, sog=3) for i in range(1, 4)])
    first = ingest.ingest(spark, [source(a)], config(), f"{uri}/runs")
    assert isinstance(first, str) and first.startswith(f"{uri}/runs/")
    assert str(ingest.ingest(spark, [source(a)], config(), tmp_path / "runs")) == first.removeprefix("file://")
    second = ingest.ingest(spark, [source(b)], config(end), f"{uri}/runs", carried=first)
    tracked = trajectories.run(spark, first, tile(), track(), f"{uri}/tracks")
    later = trajectories.run(spark, second, tile(), track(core=end), f"{uri}/tracks", (first, tracked))
    assert later == trajectories.run(spark, second, tile(), track(core=end), f"{uri}/tracks", (first, tracked)) != tracked
    assert spark.read.parquet(f"{later}/intervals").count() == 3

"""Trajectories: an ingestion run to intervals, contributions, observed points and the track state."""

from __future__ import annotations

import platform
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import plain_fingerprint
from ..functions.projection import LocalProjection
from ..operators import allocate as alloc
from ..operators import tracks
from ..operators.geometry import Tile, TileConfig
from . import ingest, jobs, store

METHOD = "spark-trajectories/1"
ARTIFACTS = {"intervals", "contributions", "points", "state"}


@dataclass(frozen=True)
class TrajectoryConfig:
    track: tracks.TrackConfig
    tile: TileConfig
    max_contributions: int
    seconds_tolerance: float = 3e-6
    km_tolerance: float = 1e-6

    def __post_init__(self) -> None:
        if isinstance(self.max_contributions, bool) or not isinstance(self.max_contributions, int) or self.max_contributions <= 0:
            raise ValueError("the cap on contributions must be a positive integer")
        if not all(0 <= t < float("inf") for t in (self.seconds_tolerance, self.km_tolerance)):
            raise ValueError("tolerances must be finite and not negative")


    def policy(self, tile: Tile) -> str:
        """What adjacent windows must have in common: everything but the core."""
        t = self.track
        settings = [t.max_gap_seconds, t.max_implied_speed_knots, self.max_contributions, self.seconds_tolerance, self.km_tolerance]
        return plain_fingerprint({"method": METHOD, "tile": tile.fingerprint, "settings": settings})


@dataclass(frozen=True)
class Tables:
    intervals: DataFrame
    contributions: DataFrame
    points: DataFrame
    state: DataFrame


def estimate(
    audit: DataFrame,
    tile: Tile,
    config: TrajectoryConfig,
    carry: DataFrame | None = None,
    keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df,
) -> Tables:
    """All results of one window; carry(mmsi, point, barrier_seen, episode_id) stands before it.

    Events are used four times and the contributions twice: keep(df, name) may write a table and reread it, so that
    adjacency, the land screen and the clipping run once.
    """
    t, projection = config.track, tile.config.projection
    e = tracks.adjacency(tracks.sliced(tracks.events_of(audit)), carry)
    e = keep(tracks.with_episodes(tracks.decided(e, t, projection, tile.screen_column)), "events")
    intervals = tracks.interval_ledger(e)
    parts = keep(alloc.allocate(intervals, t.core_start, t.core_end, tile.config.resolution, tile.parts_column), "parts")
    ledger = alloc.rolled_up(intervals, parts, t.core_start, t.core_end, tile.config.numerical_tolerance_m)
    ledger = alloc.conserved(ledger, config.seconds_tolerance, config.km_tolerance)
    points = tracks.observed_points(e, projection, tile.parts_column)
    return Tables(ledger, parts.drop("n_parts"), points, tracks.checkpoint(e, t, carry))


def require_core(config: TrajectoryConfig, ingested: dict, before: dict | None, tracked: dict | None, policy: str) -> None:
    """The core is that of the ingestion run; carried runs end where it starts, and carried trajectories have the same policy."""
    core = config.track.core_start, config.track.core_end
    if core != (jobs.instant(ingested["core_start"]), jobs.instant(ingested["core_end"])):
        raise ValueError("the core isn't that of the ingestion run")
    if any(r is not None and jobs.instant(r["core_end"]) != core[0] for r in (before, tracked)):
        raise ValueError("a carried run doesn't end where the core starts")
    if tracked is not None and tracked["policy_hash"] != policy:
        raise ValueError("the carried trajectories have another policy")


def carry_of(spark: SparkSession, ingested: Path | str, tracked: Path | str | None) -> DataFrame:
    """The carry from the ingestion run before, with the trajectory run's episodes."""
    state = spark.read.parquet(store.Folder(spark, ingested) / "state")
    if tracked is None:
        return state.withColumn("episode_id", F.lit(None).cast("string"))
    return tracks.merged_carry(state, spark.read.parquet(store.Folder(spark, tracked) / "state"))


def checked_outcomes(audit: DataFrame, counts: dict[str, int]) -> None:
    """An audit table has only outcomes of an ingestion run, as often as its receipt says."""
    found = {r["outcome"]: r["n"] for r in audit.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).collect()}
    if odd := set(found) - set(ingest.OUTCOMES):
        raise ValueError(f"unknown outcomes: {sorted(map(str, odd))}")
    if found != counts:
        raise ValueError("the audit table's rows aren't those of its receipt")


def run(
    spark: SparkSession, ingested: Path | str, tile: Tile, config: TrajectoryConfig, root: Path | str,
    carried: tuple[Path | str, Path | str | None] | None = None,
) -> Path | str:
    """Estimate over a complete ingestion run and publish, or find the same run. carried: the runs before."""
    receipt = jobs.verified_receipt(spark, ingested, ingest.METHOD, ingest.ARTIFACTS)
    prior = jobs.verified_receipt(spark, carried[0], ingest.METHOD, ingest.ARTIFACTS) if carried else None
    before = prior and prior["run_key"]
    if before != receipt["carried_run_key"]:
        raise ValueError("the carried run isn't the one that the ingestion run refers to")
    tracked = carried[1] if carried else None
    track_receipt = jobs.verified_receipt(spark, tracked, METHOD, ARTIFACTS) if tracked else None
    if track_receipt and track_receipt["ingestion_run_key"] != before:
        raise ValueError("the carried trajectories aren't of the carried ingestion run")
    policy = config.policy(tile)
    require_core(config, receipt, prior, track_receipt, policy)
    identity = {"ingestion": receipt["run_key"], "config": repr(config), "tile": tile.fingerprint, "carried": track_receipt and track_receipt["run_key"]}
    software = {"python": platform.python_version(), "pyspark": spark.version, "numpy": np.__version__}
    key = plain_fingerprint(identity | {"method": METHOD, "software": software})
    home = store.Folder(spark, root)
    if name := store.pointed(home, key):
        final = store.like(root, name)
        jobs.verified_receipt(spark, final, METHOD, ARTIFACTS)
        return final
    stage = store.begin(home, key)
    try:
        jobs.opened(stage)
        audit = spark.read.parquet(store.Folder(spark, ingested) / "audit")
        checked_outcomes(audit, receipt["counts"])

        def keep(df: DataFrame, name: str) -> DataFrame:
            path = stage / f"work/{name}"
            if name != "parts":
                return jobs.save(df, path)
            jobs.written_within(df, path, config.max_contributions, "contributions")
            return spark.read.parquet(path)

        tables = estimate(audit, tile, config, carry_of(spark, *carried) if carried else None, keep)
        if faults := alloc.contribution_faults(tables.contributions).limit(3).collect():
            raise ValueError(f"contributions that can't stand: {[tuple(f) for f in faults]}")
        made = {name: jobs.save(getattr(tables, name), stage / name) for name in sorted(ARTIFACTS)}
        stage.delete("work")
        counts = {r["outcome"]: r["n"] for r in made["intervals"].groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).collect()}
        # The inputs haven't changed meanwhile.
        jobs.verified_receipt(spark, ingested, ingest.METHOD, ingest.ARTIFACTS)
        if carried:
            jobs.verified_receipt(spark, carried[0], ingest.METHOD, ingest.ARTIFACTS)
        if tracked:
            jobs.verified_receipt(spark, tracked, METHOD, ARTIFACTS)
        receipt = {
            "method": METHOD, "software": software, "run_key": key, "policy_hash": policy,
            "core_start": config.track.core_start.isoformat(), "core_end": config.track.core_end.isoformat(),
            "ingestion_run_key": receipt["run_key"], "counts": counts,
            "artifacts": {name: jobs.content_digest(df) for name, df in made.items()},
        }
        return store.like(root, jobs.publish(stage, receipt))
    except BaseException as error:
        stage.fail(error)
        raise


def load_tile(document: dict, config: TileConfig) -> Tile:
    """A tile from its document: domain_version, water_mask_version, aoi, land, mask_support, and cells as
    {id, ring: [[lon, lat], ...]}."""
    names = {"domain_version", "water_mask_version", "aoi", "land", "mask_support", "cells"}
    d = jobs.exact_keys(document, names)
    if not all(isinstance(d[v], str) and d[v].strip() for v in ("domain_version", "water_mask_version")):
        raise ValueError("geometry versions are required")
    cells = [(c["id"], [tuple(p) for p in c["ring"]]) for c in d["cells"]]
    tile = Tile(config, d["aoi"], d["land"], d["mask_support"], cells)
    tile.require_cover()
    return tile


def load_job(path: Path) -> dict:
    """Arguments of run() from a strict job file."""
    job = jobs.exact_keys(jobs.strict_json(path), {"ingestion", "geometry", "config", "carried"})
    here = lambda p: p if "://" in p else (path.parent / p).resolve()
    c = dict(job["config"])
    projection = LocalProjection(c.pop("center_longitude"), c.pop("center_latitude"), c.pop("projection_radius_m"), c.pop("max_relative_metric_error"))
    track = tracks.TrackConfig(c.pop("max_gap_seconds"), c.pop("max_implied_speed_knots"), jobs.instant(c.pop("core_start")), jobs.instant(c.pop("core_end")))
    most = c.pop("max_contributions")
    tile = TileConfig(projection, **c)
    carried = job["carried"]
    return {
        "ingested": here(job["ingestion"]),
        "tile": load_tile(jobs.strict_json((path.parent / job["geometry"]).resolve()), tile),
        "config": TrajectoryConfig(track, tile, most),
        "carried": carried and (here(carried["ingestion"]), here(carried["trajectories"]) if carried.get("trajectories") else None),
    }

"""Ingestion: raw position text to audited, reconciled positions and the state for the next window."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import canonical_json, plain_fingerprint, record_key, retained_signature
from ..functions.parsing import HEADERS, TIME_POLICIES, Parser
from ..operators.reconcile import SpatialFilter, TimeWindow, carried_state, dealt, reconciled, with_scope
from ..sources.catalog import SourcePartition
from ..sources.rawtext import read_positions
from . import jobs, store

METHOD, SCHEMA_VERSION = "spark-ingestion/1", "positions/1"
ARTIFACTS = {"audit", "positions", "halo", "state"}
OUTCOMES = ("accepted", "duplicate", "filtered", "rejected")


@dataclass(frozen=True)
class IngestConfig:
    partition_id: str
    window: TimeWindow
    spatial: SpatialFilter
    naive_time_policy: str
    max_records: int
    max_decoded_bytes: int
    max_record_characters: int
    zstd_window_kib: int
    producer_git_sha: str

    def __post_init__(self) -> None:
        if self.naive_time_policy not in TIME_POLICIES:
            raise ValueError(f"time policy must be one of {TIME_POLICIES}")
        caps = (self.max_records, self.max_decoded_bytes, self.max_record_characters, self.zstd_window_kib)
        if any(isinstance(c, bool) or not isinstance(c, int) or c <= 0 for c in caps) or self.zstd_window_kib > 65536:
            raise ValueError("caps must be positive integers, the zstd window at most 64 MiB")

    @property
    def policy_hash(self) -> str:
        """What must stay the same along a chain of windows."""
        return plain_fingerprint({"spatial": self.spatial.__dict__, "time": self.naive_time_policy, "method": METHOD})

    @property
    def hash(self) -> str:
        caps = (self.max_records, self.max_decoded_bytes, self.max_record_characters, self.zstd_window_kib)
        return plain_fingerprint({"policy": self.policy_hash, "caps": caps})


def raw_records(spark: SparkSession, inputs: list[tuple[str, SourcePartition]], config: IngestConfig) -> DataFrame:
    """Parsed rows of all inputs with their receipt's columns, keys and row hash."""
    caps = dict(
        max_records=config.max_records, max_decoded_bytes=config.max_decoded_bytes,
        max_record_characters=config.max_record_characters, zstd_window_kib=config.zstd_window_kib,
    )
    out = None
    for era in sorted({r.source_era for _, r in inputs}):
        mine = [(p, r) for p, r in inputs if r.source_era == era]
        raw = read_positions(spark, era, [dict(path=p, asset_id=r.asset_id, sha256=r.sha256) for p, r in mine], **caps)
        parsed = Parser(era, config.naive_time_policy).parse(raw)
        receipts = spark.createDataFrame(
            [(r.asset_id, r.provider, r.sha256, era, r.start, r.end) for _, r in mine],
            "asset_id string, provider string, source_sha256 string, source_era string, declared_start timestamp, declared_end timestamp",
        )
        rows = parsed.withColumns(
            {
                "asset_id": F.col("raw.asset_id"),
                "row_start": F.col("raw.row_start"),
                "row_end": F.col("raw.row_end"),
                "record_key": record_key(F.col("raw.asset_id"), F.col("raw.row_start")),
                "raw_row_sha256": F.sha2(canonical_json({h: F.col(f"raw.{h}") for h in HEADERS[era]}), 256),
            }
        ).drop("raw")
        rows = rows.join(F.broadcast(receipts), "asset_id")  # one row for each input file
        out = rows if out is None else out.unionByName(rows)
    return out


def audited(records: DataFrame, config: IngestConfig, carried: DataFrame | None = None) -> DataFrame:
    """Every record with its outcome, scope and reasons. carried(mmsi, point, barrier_seen) is the state before."""
    rows = with_scope(records, config.spatial, config.window).withColumn("signature", retained_signature())
    rows = rows.withColumn("identity_status", F.lit("source_mmsi_unresolved"))
    if carried is not None:
        carried = carried.filter("point IS NOT NULL").select("mmsi", "point.timestamp", "point.signature", "point.record_key")
    return reconciled(rows, carried).drop("declared_start", "declared_end")


def ingest(
    spark: SparkSession, inputs: list[tuple[str, SourcePartition]], config: IngestConfig, root: Path | str, carried: Path | str | None = None
) -> Path | str:
    """Run, or find the same run, and return its directory: audit, positions, halo and state tables with a receipt.

    root is a local path or the URI of a folder on any file system that Spark reaches; see store.py for how a run becomes visible. A
    failed one leaves a failure note instead. The carried run must be complete, of the same policy, and end where this core starts.
    """
    if not inputs or len({r.asset_id for _, r in inputs}) != len(inputs):
        raise ValueError("inputs need distinct asset ids")
    for _, receipt in inputs:
        receipt.require_normalization()
    before, prior, w = None, None, config.window
    if carried is not None:
        before = jobs.verified_receipt(spark, carried, METHOD, ARTIFACTS)
        if before["policy_hash"] != config.policy_hash or jobs.instant(before["core_end"]) != w.core_start:
            raise ValueError("the carried run has another policy or isn't adjacent")
        prior = spark.read.parquet(store.Folder(spark, carried) / "state")
    manifest = jobs.Manifest(
        config.partition_id, tuple(r.sha256 for _, r in inputs), config.hash, METHOD, SCHEMA_VERSION, config.producer_git_sha,
        w.core_start, w.core_end, w.halo_start, w.halo_end, before and before["run_key"],
    )
    own = sorted(json.dumps({k: str(v) for k, v in r.__dict__.items()}, sort_keys=True) for _, r in inputs)
    key = plain_fingerprint({"manifest": manifest.key, "receipts": own})
    home = store.Folder(spark, root)
    if name := store.pointed(home, key):
        final = store.like(root, name)
        jobs.verified_receipt(spark, final, METHOD, ARTIFACTS)
        return final
    stage = store.begin(home, key)
    try:
        jobs.opened(stage)
        audit = audited(raw_records(spark, inputs, config), config, prior)
        tally = {o: F.count(F.when(F.col("outcome") == o, 1)) for o in OUTCOMES}
        seen = jobs.written_within(dealt(audit), stage / "audit", config.max_records, "records", **tally)
        counts = {o: seen[o] for o in OUTCOMES if seen[o]}
        if sum(counts.values()) != seen["rows"]:
            raise ValueError("a record has no known outcome")
        audit = spark.read.parquet(stage / "audit")
        accepted = audit.filter("outcome = 'accepted'").drop("carried_conflict")
        jobs.save(accepted.filter("scope = 'core'"), stage / "positions")
        jobs.save(accepted.filter("scope = 'halo'"), stage / "halo")
        jobs.save(carried_state(audit, w.core_end, prior), stage / "state")
        found = {r["asset_id"] for r in audit.select("asset_id").distinct().collect()}
        if missing := {r.asset_id for _, r in inputs} - found:
            raise ValueError(f"empty sources: {sorted(missing)}")
        # The inputs are still what their receipts say.
        hashes = jobs.digests_of(spark, [p for p, _ in inputs])
        if changed := [r.asset_id for p, r in inputs if hashes[p] != r.sha256]:
            raise ValueError(f"files changed while they were read: {changed}")
        if carried is not None:
            jobs.verified_receipt(spark, carried, METHOD, ARTIFACTS)
        receipt = {
            "method": METHOD, "schema_version": SCHEMA_VERSION, "run_key": key, "policy_hash": config.policy_hash,
            "core_start": w.core_start.isoformat(), "core_end": w.core_end.isoformat(), "counts": dict(sorted(counts.items())),
            "input_rows": seen["rows"], "carried_run_key": before and before["run_key"],
            "artifacts": {a: jobs.content_digest(spark.read.parquet(stage / a)) for a in sorted(ARTIFACTS)},
        }
        return store.like(root, jobs.publish(stage, receipt))
    except BaseException as error:
        stage.fail(error)
        raise


def load_job(path: Path) -> tuple[list[tuple[str, SourcePartition]], IngestConfig]:
    """Inputs and configuration of a strict job file; relative paths are from the file's directory."""
    job = jobs.exact_keys(jobs.strict_json(path), {"inputs", "config"})
    inputs = []
    for item in job["inputs"]:
        r = dict(jobs.exact_keys(item, {"path", "receipt"})["receipt"])
        for name in ("start", "end", "acquired_at"):
            r[name] = jobs.instant(r[name])
        inputs.append((str((path.parent / item["path"]).resolve()), SourcePartition(**r)))
    c = dict(job["config"])
    window = TimeWindow(*(jobs.instant(c.pop(n)) for n in ("core_start", "core_end", "halo_start", "halo_end")))
    return inputs, IngestConfig(window=window, spatial=SpatialFilter(**c.pop("spatial")), **c)

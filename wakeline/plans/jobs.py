"""Strict job files, run identities, and publication of run directories."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import plain_fingerprint
from .store import FILE_ROWS, Attempt, Folder, pointed

MAX_JOB_BYTES = 1 << 20


def strict_json(path: Path) -> dict:
    """A JSON document without repeated keys or non-finite numbers."""
    if path.stat().st_size > MAX_JOB_BYTES:
        raise ValueError("the job file is larger than 1 MiB")
    return strict_text(path.read_text())


def strict_text(text: str) -> dict:
    def once(pairs):
        if len({k for k, _ in pairs}) != len(pairs):
            raise ValueError("a JSON key repeats")
        return dict(pairs)

    def refuse(text):
        raise ValueError(f"{text} isn't JSON")

    return json.loads(text, object_pairs_hook=once, parse_constant=refuse)


def exact_keys(document: dict, names: set[str]) -> dict:
    if set(document) != names:
        raise ValueError(f"the keys must be exactly {sorted(names)}")
    return document


def instant(text: str) -> datetime:
    t = datetime.fromisoformat(text)
    if t.tzinfo is None:
        raise ValueError(f"{text} has no zone")
    return t.astimezone(timezone.utc)


@dataclass(frozen=True)
class Manifest:
    """What identifies a run; equal manifests are the same run."""

    partition_id: str
    source_hashes: tuple[str, ...]
    config_hash: str
    method: str
    schema_version: str
    producer_git_sha: str
    core_start: datetime
    core_end: datetime
    halo_start: datetime
    halo_end: datetime
    prior_state: str | None = None

    def __post_init__(self) -> None:
        if not self.halo_start <= self.core_start < self.core_end <= self.halo_end:
            raise ValueError("the halo must hold a positive core")
        if not self.source_hashes or not all(re.fullmatch("[0-9a-f]{64}", h) for h in (*self.source_hashes, self.config_hash)):
            raise ValueError("SHA-256 hashes are required")
        if not re.fullmatch("[0-9a-f]{40}", self.producer_git_sha):
            raise ValueError("a full commit id is required")
        if not (self.partition_id and self.method and self.schema_version):
            raise ValueError("partition, method and schema version are required")

    @property
    def key(self) -> str:
        d = dict(self.__dict__) | {"source_hashes": sorted(self.source_hashes)}
        return plain_fingerprint({k: v.isoformat() if isinstance(v, datetime) else v for k, v in d.items()})


def content_digest(df: DataFrame) -> str:
    """A digest of a table's rows that doesn't depend on their order or files: count and sums of row hashes."""
    text = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    h = F.sha2(text, 256)
    part = lambda i: F.sum(F.conv(F.substring(h, i, 12), 16, 10).cast("decimal(38,0)"))
    row = df.agg(F.count(F.lit(1)), *(part(1 + 12 * i) for i in range(4))).first()
    return plain_fingerprint([str(x) for x in row])


def digests_of(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """sha256 of each file, taken in tasks; one that a task doesn't see is an error, so the paths are on a shared mount."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, found = batch.column("path").to_pylist(), []
            for name in names:
                with open(name, "rb") as f:
                    found.append(hashlib.file_digest(f, "sha256").hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.string())], ["path", "sha256"])

    if not paths:
        return {}
    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(min(len(paths), 1000), "path")
    return {r["path"]: r["sha256"] for r in files.mapInArrow(digests, "path string, sha256 string").collect()}


def require_shared(spark: SparkSession, folder: Path) -> None:
    """Refuse a folder that some tasks don't see: on a cluster, what they write there would stay on their own disks."""
    mark = folder / ".shared"
    name = str(mark)
    mark.write_text(folder.name)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = os.path.exists(name)
            yield pa.RecordBatch.from_arrays([pa.array([seen] * batch.num_rows, pa.bool_())], ["seen"])

    tasks = 2 * spark.sparkContext.defaultParallelism
    try:
        if not all(r["seen"] for r in spark.range(0, tasks, 1, tasks).mapInArrow(look, "seen boolean").collect()):
            raise ValueError(f"{folder} is not a folder that the driver and all executors share")
    finally:
        mark.unlink()


def publish(stage: Attempt, receipt: dict) -> str:
    """Digest the attempt's files, write its receipt and put the pointer; the name of the attempt that stands for the key."""
    return stage.publish(receipt | {"status": "complete", "files": content_digest(stage.files())})


def save(df: DataFrame, path: Path | str) -> DataFrame:
    """Write a table of a run, in files of bounded size, and read it back."""
    df.write.option("compression", "zstd").option("maxRecordsPerFile", FILE_ROWS).parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def written_within(df: DataFrame, path: Path | str, most: int, what: str, **metrics: Column) -> dict[str, int]:
    """Write df as Parquet and return its number of rows and the metrics (aggregates), observed as rows are written.

    More than `most` rows are an error. A task that alone has more stops the job before it writes further; the sum of all
    tasks is known, without another scan, when the last one ends. A task that runs again counts once.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # of a row in its partition
    within = F.when(place < most, F.lit(True)).otherwise(F.raise_error(F.lit(f"more than {most} {what}")).cast("boolean"))
    seen = Observation()
    watched = df.filter(within).observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in metrics.items()])
    save(watched, path)
    found = {"rows": 0} | dict.fromkeys(metrics, 0) | seen.get  # a plan without rows may observe nothing
    if found["rows"] > most:
        raise ValueError(f"{found['rows']} {what}, more than {most}")
    return found


def verified_receipt(spark: SparkSession, directory: Path | str, method: str, artifacts: set[str]) -> dict:
    """The receipt of a published run whose files are as they were."""
    folder = Folder(spark, directory)
    key = folder.name.partition("-")[0]
    if not folder.has("complete.json") or pointed(folder.parent, key) != folder.name:
        raise ValueError(f"{directory} isn't a complete run")
    receipt = strict_text(folder.read("complete.json"))
    if receipt.get("status") != "complete" or receipt.get("method") != method or receipt.get("run_key") != key:
        raise ValueError(f"{directory}: the receipt doesn't belong to it")
    try:
        same = receipt["files"] == content_digest(folder.files())
    except (Py4JJavaError, PySparkException) as error:
        raise ValueError(f"{directory}: its files can't be read") from error
    if set(receipt["artifacts"]) != artifacts or not same:
        raise ValueError(f"{directory}: its files have changed")
    return receipt


def opened(stage: Attempt) -> Attempt:
    """An attempt whose folder all tasks see: only a folder on local disks can be one that they don't."""
    if stage.local:
        require_shared(stage.spark, stage.local_path)
    return stage

"""The static source catalog and receipts of source partitions."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from ..functions.parsing import HEADERS

IMPLEMENTED = "noaa_marinecadastre"
#: Provider, delivery, adapter status, access status.
CATALOG = (
    (IMPLEMENTED, "CSV.zst (2015 onward); implemented parser eras start 2018", "offline_local_ingestion", "no_acquisition_authorized"),
    ("canada_configurable", None, "unavailable_pending_access", "unverified"),
)
AVAILABILITY = ("catalogued", "available", "unavailable", "quarantined")


def catalog_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CATALOG), "provider string, delivery string, adapter_status string, access_status string")


@dataclass(frozen=True)
class SourcePartition:
    """A receipt for one asset; bounds are half-open instants with a zone."""

    provider: str
    asset_id: str
    sha256: str | None
    acquired_at: datetime | None
    start: datetime
    end: datetime
    source_era: str
    schema_verified: bool
    rights_evidence: str | None
    coverage_evidence: str | None
    availability: str

    def __post_init__(self) -> None:
        for t in (self.start, self.end, *([self.acquired_at] if self.acquired_at else [])):
            if t.tzinfo is None:
                raise ValueError("instants need a zone")
        if self.end <= self.start:
            raise ValueError("a partition must end after it starts")
        if self.availability not in AVAILABILITY:
            raise ValueError(f"availability must be one of {AVAILABILITY}")

    def require_normalization(self) -> None:
        """Raise for the first thing that keeps the partition from being read."""
        checks = (
            (self.provider == IMPLEMENTED, "the provider has no implemented adapter"),
            (self.source_era in HEADERS, "the era is unknown"),
            (self.availability == "available" and self.schema_verified, "the partition is unavailable or its schema unverified"),
            (bool(re.fullmatch(r"[0-9a-f]{64}", self.sha256 or "")), "a verified SHA-256 is required"),
            (bool(self.acquired_at and self.rights_evidence and self.coverage_evidence), "acquisition, rights and coverage evidence is required"),
        )
        for ok, message in checks:
            if not ok:
                raise ValueError(message)

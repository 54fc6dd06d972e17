"""Record keys, canonical JSON and fingerprints."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGNATURE = ("equipment_class", "imo", "latitude", "longitude", "quality_flags", "raw_vessel_code", "sog_knots")
RAW_NAMES = "raw"


def record_key(asset: Column, row: Column) -> Column:
    """asset:row with the row padded to 20 digits."""
    return F.concat(asset, F.lit(":"), F.lpad(row.cast("string"), 20, "0"))


def canonical_json(columns: dict[str, Column]) -> Column:
    """JSON of the columns by sorted key, compact, with nulls."""
    fields = [columns[k].alias(k) for k in sorted(columns)]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def fingerprint(columns: dict[str, Column]) -> Column:
    return F.sha2(canonical_json(columns), 256)


def retained_signature() -> Column:
    """Hash of what two reports of one vessel and instant must agree on."""
    return fingerprint({k: F.col(k) for k in SIGNATURE})


def plain_fingerprint(value) -> str:
    """The driver's side: sha256 of canonical JSON (sorted, compact, finite numbers only)."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()

"""Where records begin in large plain csv files, found by many tasks at once.

Whether a line end closes a record depends on the quotes before it, back to the file's begin. A first pass reads byte
ranges, each for itself: a run of quotes at a field's begin toggles "within quotes", a run elsewhere can only close, so a
range maps the state before it to one of few states after it, and has two possible first records. Windows over these
small rows (one a range) then compose the maps along each file and sum up lines and records. The second pass reads
each range's records from its true first one. Each pass reads the file once, in as many tasks as there are ranges.

Quotes, commas and line ends are single bytes in UTF-8, so ranges may cut characters and line ends anywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUOTE, COMMA, LF, CR, BOM = 34, 44, 10, 13, b"\xef\xbb\xbf"
#: Most tasks of a pass; further ranges share them.
MOST_TASKS = 20_000
SUMMARY = "asset_id string, path string, begin long, end long, lines long, after array<int>, first array<long>, above array<long>, records array<long>"


def text_begin(file: BinaryIO) -> int:
    """The file's first byte after a byte order mark."""
    file.seek(0)
    return len(BOM) if file.read(len(BOM)) == BOM else 0


def summarised(file: BinaryIO, begin: int, end: int) -> dict:
    """What bytes [begin, end) do, for the state before them outside (0) and within (1) quotes.

    lines: physical lines that begin in the range (the file's first isn't counted). For each state: after, the state
    behind the range; first, the first byte of the first record that begins in it, or null; above, the lines that begin in the range
    up to there; records, how many that aren't blank begin in it. A run of quotes belongs to the range it begins in.
    """
    base = max(begin - 1, 0)
    file.seek(base)
    data = file.read(end - base + 1)
    while data.endswith(b'"') and (more := file.read(1 << 16)):
        data += more
    b = np.frombuffer(data, dtype=np.uint8)
    limit = end - base
    top = len(BOM) if begin == 0 and data.startswith(BOM) else 0

    quotes = np.flatnonzero(b == QUOTE)
    heads = np.flatnonzero(np.diff(quotes, prepend=-2) > 1)
    run, length = quotes[heads], np.diff(heads, append=len(quotes))
    own = (run >= begin - base) & (run < limit) & (length % 2 == 1)  # an even run is as if it weren't there
    run = run[own]
    previous = b[np.maximum(run - 1, 0)]
    toggles = np.isin(previous, (COMMA, LF, CR))
    if begin == 0:
        toggles |= run == top
    total = np.cumsum(toggles)
    closing = np.maximum.accumulate(np.where(toggles, -1, np.arange(len(run))))

    ends = b == LF
    bare = np.flatnonzero(b == CR)
    ends[bare[(bare + 1 >= len(b)) | (b[np.minimum(bare + 1, len(b) - 1)] != LF)]] = True
    line = np.flatnonzero(ends) + 1
    line = line[(line >= begin - base) & (line < limit)]
    behind = np.searchsorted(run, line)  # runs before each line
    filled = np.isin(b[line], (LF, CR), invert=True)
    out: dict = {"lines": len(line), "after": [], "first": [], "above": [], "records": []}
    for state in (0, 1):
        states = np.where(closing >= 0, total - total[closing], total + state) % 2 if len(run) else total
        at = np.concatenate([[state], states])
        opens = at[behind] == 0
        first = int(np.argmax(opens)) if opens.any() else None
        where, above = (None, 0) if first is None else (base + int(line[first]), first + 1)
        records = int((opens & filled).sum())
        if begin == 0 and state == 0 and top < limit:  # the file's first line
            where, above, records = top, 0, records + int(b[top] not in (LF, CR))
        out["after"].append(int(at[-1]))
        out["first"].append(where)
        out["above"].append(above)
        out["records"].append(records)
    return out


def _hashed(file: BinaryIO, path: str, sha256: str) -> None:
    file.seek(0)
    if hashlib.file_digest(file, "sha256").hexdigest() != sha256:
        raise ValueError(f"{path}: its SHA-256 isn't the receipt's")


def record_ranges(spark: SparkSession, assets: list[dict], split_bytes: int) -> DataFrame:
    """asset_id, path, first, end, line, before: for each range [.., end) in which a record begins, its first byte and
    physical line, and how many records begin earlier in the file. assets: path, asset_id, size, sha256 (or none).

    A file with a digest is hashed by one more task, beside the ranges: the digest can't be cut.
    """
    if split_bytes < 4:
        raise ValueError("a range must be able to hold a byte order mark")
    files = spark.createDataFrame([(a["asset_id"], a["path"], a["size"], a.get("sha256")) for a in assets], "asset_id string, path string, size long, sha256 string")
    step = F.lit(split_bytes)
    cut = files.select("asset_id", "path", F.explode(F.expr(f"sequence(0, size - 1, {int(split_bytes)})")).alias("begin"), "size", F.lit(None).cast("string").alias("sha256"))
    cut = cut.select("asset_id", "path", "begin", F.least(F.col("begin") + step, "size").alias("end"), "sha256")
    whole = files.filter("sha256 IS NOT NULL").select("asset_id", "path", F.lit(0).cast("long").alias("begin"), F.col("size").alias("end"), "sha256")
    n = min(sum(-(-a["size"] // split_bytes) + 1 for a in assets), MOST_TASKS)

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                with open(r["path"], "rb") as file:
                    if r["sha256"]:
                        _hashed(file, r["path"], r["sha256"])
                    else:
                        found.append({k: r[k] for k in ("asset_id", "path", "begin", "end")} | summarised(file, r["begin"], r["end"]))
            if found:
                yield pa.RecordBatch.from_pylist(found, schema=ARROW_SUMMARY)

    ranges = whole.unionByName(cut).repartition(n).mapInArrow(first_pass, SUMMARY)
    order = Window.partitionBy("asset_id", "path").orderBy("begin")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    # A range whose two ends are equal sets the state; else it keeps or toggles what was before.
    sets = F.col("after")[0] == F.col("after")[1]
    toggles = F.when(sets, 0).otherwise(F.col("after")[0])
    told = ranges.withColumn("toggled", F.sum(toggles).over(order))
    told = told.withColumns(
        {
            "set": F.last(F.when(sets, F.struct(F.col("after")[0].alias("state"), "toggled")), ignorenulls=True).over(earlier),
            "since": F.coalesce(F.sum(toggles).over(earlier), F.lit(0)),
        }
    )
    state = F.coalesce(F.col("set.state"), F.lit(0)) + F.col("since") - F.coalesce(F.col("set.toggled"), F.lit(0))
    told = told.withColumn("state", F.pmod(state, F.lit(2)).cast("int"))
    pick = lambda name: F.get(F.col(name), F.col("state"))
    summed = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    out = told.select(
        "asset_id", "path", pick("first").alias("first"), "end", (F.lit(1) + summed(F.col("lines")) + pick("above")).alias("line"),
        summed(pick("records")).alias("before"),
    )
    return out.filter("first IS NOT NULL").repartition(n)


ARROW_SUMMARY = pa.schema(
    [("asset_id", pa.string()), ("path", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("lines", pa.int64()), ("after", pa.list_(pa.int32()))]
    + [(name, pa.list_(pa.int64())) for name in ("first", "above", "records")]
)

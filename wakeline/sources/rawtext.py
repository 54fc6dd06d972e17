"""Delimited position text with physical line numbers.

Built-in CSV reading has no line numbers and turns faults into nulls; here a fault ends the read. A compressed asset
is a single frame and so one partition of a data source, as is a small plain one. A large plain asset is cut into byte
ranges: see splits.py. Files are streamed, not loaded, and rows leave as Arrow batches.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.parsing import HEADERS, check_headers
from . import splits

#: Plain assets above this size are cut into ranges of about it.
SPLIT_BYTES = 32 << 20
#: Rows and characters of a batch, whichever is reached first.
BATCH_ROWS, BATCH_CHARACTERS = 8192, 16 << 20
#: Caps where none are given.
MOST_BYTES, MOST_CHARACTERS, MOST_RECORDS = 1 << 40, 1 << 20, 1 << 40


class AssetPartition(InputPartition):
    def __init__(self, path: str, asset: str, sha256: str | None):
        self.path, self.asset, self.sha256 = path, asset, sha256


class _Counting(io.RawIOBase):
    """Reads through, hashing what is read and refusing more than a number of bytes."""

    def __init__(self, inner, most: int, name: str):
        self.inner, self.most, self.name_, self.seen, self.digest = inner, most, name, 0, hashlib.sha256()

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.inner.read(len(buffer))
        self.seen += len(data)
        if self.seen > self.most:
            raise ValueError(f"{self.name_}: more than {self.most} bytes")
        self.digest.update(data)
        buffer[: len(data)] = data
        return len(data)


def single_frame(raw, window_kib: int, chunk: int = 1 << 16) -> Iterator[bytes]:
    """Decoded pieces of exactly one zstd frame; a cut frame and bytes after it are errors."""
    import zstandard

    frame = zstandard.ZstdDecompressor(max_window_size=window_kib * 1024).decompressobj()
    while data := raw.read(chunk):
        if frame.eof:
            raise ValueError("bytes follow the compressed frame")
        yield frame.decompress(data)
        if frame.unused_data:
            raise ValueError("bytes follow the compressed frame")
    if not frame.eof:
        raise ValueError("the compressed frame is cut off")


class _Pieces(io.RawIOBase):
    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.rest = pieces, b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.rest:
            piece = next(self.pieces, None)
            if piece is None:
                return 0
            self.rest = piece
        n = min(len(buffer), len(self.rest))
        buffer[:n], self.rest = self.rest[:n], self.rest[n:]
        return n


class Lines:
    """Lines of a text, with the characters since a record began and the bytes since the text did."""

    def __init__(self, text: io.TextIOBase, most_characters: int):
        self.text, self.most, self.size, self.bytes = text, most_characters, 0, 0

    def __iter__(self) -> Lines:
        return self

    def __next__(self) -> str:
        line = next(self.text)
        self.size += len(line)
        if self.size > self.most:
            raise ValueError("a record has too many characters")
        self.bytes += len(line) if line.isascii() else len(line.encode())
        return line


def records_of(lines: Lines, line: int = 1, end: int | None = None) -> Iterator[tuple[int, int, list[str]]]:
    """(first line, last line, fields) of each record that begins before byte `end`; blank lines count as lines only."""
    reader = csv.reader(lines, strict=True)
    while end is None or lines.bytes < end:
        start, lines.size = line + reader.line_num, 0
        try:
            record = next(reader)
        except StopIteration:
            return
        except csv.Error as error:
            raise ValueError(f"line {start}: {error}") from error
        if record:
            yield start, line + reader.line_num - 1, record


def header_of(records: Iterator[tuple[int, int, list[str]]], era: str) -> tuple[list[int], int, int]:
    """Where the era's columns are, the number of fields, and the header's last line."""
    for _, last, header in records:
        check_headers(header, era)
        return [header.index(h) for h in HEADERS[era]], len(header), last
    raise ValueError("there is no header")


def rows_of(
    records: Iterator[tuple[int, int, list[str]]], order: list[int], width: int, most_records: int
) -> Iterator[tuple[int, int, list[str]]]:
    """Records with their fields in the era's order; another width and too many records are errors."""
    for n, (start, last, record) in enumerate(records, 1):
        if len(record) != width:
            raise ValueError(f"line {start}: {len(record)} fields instead of {width}")
        if n > most_records:
            raise ValueError("too many records")
        yield start, last, [record[i] for i in order]


def batches_of(asset: str, rows: Iterator[tuple[int, int, list[str]]], era: str) -> Iterator[pa.RecordBatch]:
    names = ["asset_id", "row_start", "row_end", *HEADERS[era]]
    starts, ends, fields, size = [], [], [], 0

    def batch() -> pa.RecordBatch:
        fixed = [pa.array([asset] * len(starts), pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())]
        return pa.RecordBatch.from_arrays(fixed + [pa.array(c, pa.string()) for c in zip(*fields)], names)

    for start, end, record in rows:
        starts.append(start)
        ends.append(end)
        fields.append(record)
        size += sum(map(len, record))
        if len(starts) >= BATCH_ROWS or size >= BATCH_CHARACTERS:
            yield batch()
            starts, ends, fields, size = [], [], [], 0
    if starts:
        yield batch()


def raw_schema(era: str) -> StructType:
    fixed = [StructField("asset_id", StringType()), StructField("row_start", LongType()), StructField("row_end", LongType())]
    return StructType(fixed + [StructField(h, StringType()) for h in HEADERS[era]])


class RawPositions(DataSource):
    """Options: assets (JSON list of {path, asset_id, sha256}), era, and caps."""

    @classmethod
    def name(cls) -> str:
        return "raw_positions"

    def schema(self) -> StructType:
        return raw_schema(self.options["era"])

    def reader(self, schema: StructType) -> DataSourceReader:
        return RawReader(dict(self.options))


class RawReader(DataSourceReader):
    def __init__(self, options: dict):
        self.era = options["era"]
        self.assets = json.loads(options["assets"])
        cap = lambda name, default: int(options.get(name, default))
        self.bytes, self.characters = cap("max_decoded_bytes", MOST_BYTES), cap("max_record_characters", MOST_CHARACTERS)
        self.records, self.window = cap("max_records", MOST_RECORDS), cap("zstd_window_kib", 65536)

    def partitions(self) -> list[InputPartition]:
        return [AssetPartition(a["path"], a["asset_id"], a.get("sha256")) for a in self.assets]

    def read(self, partition: AssetPartition) -> Iterator[pa.RecordBatch]:
        path = partition.path
        if not path.endswith((".csv", ".csv.zst")):
            raise ValueError(f"{path}: .csv or .csv.zst is required")
        with open(path, "rb") as file:
            raw = _Counting(file, os.path.getsize(path), path)
            plain = _Pieces(single_frame(raw, self.window)) if path.endswith(".zst") else raw
            text = io.TextIOWrapper(io.BufferedReader(_Counting(plain, self.bytes, path)), encoding="utf-8-sig", newline="")
            records = records_of(Lines(text, self.characters))
            order, width, _ = header_of(records, self.era)
            yield from batches_of(partition.asset, rows_of(records, order, width, self.records), self.era)
            if partition.sha256 and raw.digest.hexdigest() != partition.sha256:
                raise ValueError(f"{path}: its SHA-256 isn't the receipt's")


def rows_between(path: str, era: str, begin: int, end: int, line: int, before: int, most_characters: int, most_records: int):
    """The rows of the records that begin in bytes [begin, end); `begin` is a record's first byte and on that line.

    The header is read from the file's begin. before: how many records, header included, begin earlier in the file.
    """
    with open(path, "rb") as file:
        top = splits.text_begin(file)

        def lines(at: int) -> Lines:
            file.seek(at)
            return Lines(io.TextIOWrapper(io.BufferedReader(_Unclosed(file)), encoding="utf-8", newline=""), most_characters)

        head = lines(top)
        order, width, last = header_of(records_of(head), era)
        if begin < top + head.bytes:  # the header and blank lines above it are no rows
            begin, line, before = top + head.bytes, last + 1, 1
        records = records_of(lines(begin), line, end - begin)
        yield from rows_of(records, order, width, most_records - (before - 1))


class _Unclosed(io.RawIOBase):
    """A file that stays open when its readers are gone."""

    def __init__(self, file):
        self.file = file

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


def read_split(spark: SparkSession, era: str, assets: list[dict], split_bytes: int, most_characters: int, most_records: int) -> DataFrame:
    """The same rows as of the data source, from byte ranges of plain files, as many tasks as ranges."""
    found = splits.record_ranges(spark, assets, split_bytes)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows = rows_between(r["path"], era, r["first"], r["end"], r["line"], r["before"], most_characters, most_records)
                yield from batches_of(r["asset_id"], rows, era)

    return found.mapInArrow(read, raw_schema(era))


def read_positions(spark: SparkSession, era: str, assets: list[dict], split_bytes: int = SPLIT_BYTES, **caps) -> DataFrame:
    """asset_id, row_start, row_end and the era's 17 text columns of files that the driver and all executors can open."""
    sizes = {a["path"]: os.path.getsize(a["path"]) if a["path"].endswith(".csv") else 0 for a in assets}
    large = [a | {"size": sizes[a["path"]]} for a in assets if sizes[a["path"]] > split_bytes]
    small = [a for a in assets if sizes[a["path"]] <= split_bytes]
    out = None
    if small or not large:
        spark.dataSource.register(RawPositions)
        reader = spark.read.format("raw_positions").option("era", era).option("assets", json.dumps(small))
        for name, value in caps.items():
            reader = reader.option(name, value)
        out = reader.load()
    if large:
        for a in large:
            if a["size"] > caps.get("max_decoded_bytes", MOST_BYTES):
                raise ValueError(f"{a['path']}: more than {caps['max_decoded_bytes']} bytes")
        limits = caps.get("max_record_characters", MOST_CHARACTERS), caps.get("max_records", MOST_RECORDS)
        cut = read_split(spark, era, large, split_bytes, *limits)
        out = cut if out is None else out.unionByName(cut)
    return out

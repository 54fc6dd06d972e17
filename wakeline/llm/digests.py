"""Document fingerprints: digests of bucket quartiles of hashed byte triplets, and their likeness."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import pieces
from .common import body

#: Buckets of triplets; a triplet, as a number of 24 bits, goes to the highest 8 bits of its product with FACTOR (32 bits).
BUCKETS, FACTOR = 256, 2654435761
#: Score between two codes of a bucket by their distance.
STEP = np.array([0, 1, 2, 6], dtype=np.int64)
#: Score for each step between two lengths, up to so many steps, and for each between ratios of quartiles.
LENGTH_STEP, LENGTH_STEPS, RATIO_STEP = 4, 32, 4
#: Scores from here on count as no likeness at all.
BOUND = 512
#: Bytes of a text counted at once.
BLOCK = 1 << 20


def length_bounds() -> np.ndarray:
    """Where length codes 1 to 255 begin: one byte, then each an eighth more than the last, at least one more."""
    bounds = [1]
    while len(bounds) < 255:
        bounds.append(bounds[-1] + max(1, bounds[-1] // 8))
    return np.array(bounds, dtype=np.int64)


BOUNDS = length_bounds()


def bucket_counts(texts: list[bytes]) -> np.ndarray:
    """The number of triplets in each bucket, a row for each text; long texts are counted block by block."""
    out = np.zeros((len(texts), BUCKETS), dtype=np.int64)
    ends = np.cumsum([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    for a in range(0, max(0, len(data) - 2), BLOCK):
        part = data[a : a + BLOCK + 2].astype(np.uint32)
        at = np.arange(a, a + len(part) - 2)
        owner = np.searchsorted(ends, at, side="right")
        whole = at + 2 < ends[owner]
        bucket = (((part[:-2] << 16) | (part[1:-1] << 8) | part[2:]) * np.uint32(FACTOR)) >> 24
        first, last = owner[0], owner[-1]
        seen = np.bincount(((owner - first) * BUCKETS + bucket)[whole], minlength=(last - first + 1) * BUCKETS)
        out[first : last + 1] += seen.reshape(-1, BUCKETS)
    return out


def digests(texts: list[bytes]) -> np.ndarray:
    """A row of 66 bytes for each text: length code, two ratios of quartiles, and two bits for each bucket.

    A bucket's code says which quartile of the text's own counts its count is in. All-zero counts give codes of zero.
    """
    counts = bucket_counts(texts)
    ordered = np.sort(counts, axis=1)
    q = [ordered[:, BUCKETS * part // 4 - 1] for part in (1, 2, 3)]
    code = sum((counts > level[:, None]).astype(np.uint8) for level in q)
    third = np.maximum(q[2], 1)
    ratio = [np.minimum(15, 16 * level // third).astype(np.uint8) for level in q[:2]]
    length = np.searchsorted(BOUNDS, np.array([len(t) for t in texts], dtype=np.int64), side="right").astype(np.uint8)
    four = code.reshape(len(texts), -1, 4)
    packed = (four[:, :, 0] << 6) | (four[:, :, 1] << 4) | (four[:, :, 2] << 2) | four[:, :, 3]
    return np.concatenate([length[:, None], ((ratio[0] << 4) | ratio[1])[:, None], packed], axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """From 1 (equal digests) down to 0 (a difference score of BOUND or more), row by row."""
    far = lambda x, y: np.abs(x.astype(np.int64) - y.astype(np.int64))
    score = LENGTH_STEP * np.minimum(far(a[:, 0], b[:, 0]), LENGTH_STEPS)
    score += RATIO_STEP * (far(a[:, 1] >> 4, b[:, 1] >> 4) + far(a[:, 1] & 15, b[:, 1] & 15))
    for shift in (6, 4, 2, 0):
        score += STEP[far((a[:, 2:] >> shift) & 3, (b[:, 2:] >> shift) & 3)].sum(axis=1)
    return 1 - np.minimum(score, BOUND) / BOUND


def as_hex(rows: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in rows]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, fingerprint (132 hex digits). Null counts as empty; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "_text"):
                texts = [t.encode() for t in piece.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(as_hex(digests(texts)), pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).alias("_text")).mapInArrow(run, "doc_id bigint, fingerprint string")


def compared(a: Column, b: Column) -> Column:
    """The likeness of two columns of fingerprints; null where one is null."""

    @F.pandas_udf("double")
    def scored(x: pd.Series, y: pd.Series) -> pd.Series:
        both = x.notna() & y.notna()
        rows = lambda s: np.frombuffer(bytes.fromhex("".join(s[both])), dtype=np.uint8).reshape(-1, 2 + BUCKETS // 4)
        out = pd.Series(np.nan, index=x.index, dtype=object).where(both, None)
        if both.any():
            out[both] = likeness(rows(x), rows(y))
        return out

    return scored(a, b)


def _first_ids(docs: DataFrame, parts: int) -> np.ndarray:
    """The smallest id of each of about equally large ranges of ids, in order; at most parts of them come to the driver.

    Percentiles are computed in doubles, which don't hold all ids, so they only say where ranges are cut.
    """
    shares = [i / parts for i in range(1, parts)]
    cuts = np.unique(np.array(docs.agg(F.percentile_approx("_id", shares, 20 * parts)).first()[0] or [] if shares else [], dtype=np.int64))

    @F.pandas_udf("long")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(dtype=np.int64), side="right"))

    known = docs.filter(F.col("_id").isNotNull()).select("_id")
    return np.array(sorted(r[0] for r in known.groupBy(place("_id")).agg(F.min("_id").alias("first")).select("first").collect()), dtype=np.int64)


def in_ranges(docs: DataFrame) -> DataFrame:
    """docs(_id, _text) with _part and _next, one range of ids in each partition, sorted by _part, _next, _id, _text.

    The first row of each range (each of them, if its id repeats) is there a second time, marked _next, at the end of the range
    before, the first range's at the end of the last: so each row is followed by the next of the order, across ranges too.
    Rows without an id are spread by their texts.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    begins = _first_ids(docs, parts)
    ranges = max(1, len(begins))

    @F.pandas_udf("long")
    def place(ids: pd.Series) -> pd.Series:
        """Twice the range, one more for the range's first id."""
        i = ids.to_numpy(dtype=np.int64)
        part = np.searchsorted(begins[1:], i, side="right")
        return pd.Series(2 * part + (begins[part] == i if len(begins) else False))

    at = F.when(F.col("_id").isNull(), 2 * F.pmod(F.xxhash64("_text"), F.lit(ranges))).otherwise(F.col("_at"))
    placed = docs.withColumn("_at", place(F.coalesce("_id", F.lit(0)))).withColumn("_at", at)
    own = F.struct(F.shiftright("_at", 1).alias("part"), F.lit(False).alias("next"))
    before = F.struct(F.pmod(F.shiftright("_at", 1) - 1, F.lit(ranges).cast("long")).alias("part"), F.lit(True).alias("next"))
    copies = F.when((F.col("_at") % 2 == 1) & F.col("_id").isNotNull(), F.array(own, before)).otherwise(F.array(own))
    dealt = placed.select("_id", "_text", F.explode(copies).alias("_c")).select(F.col("_c.part").cast("int").alias("_part"), F.col("_c.next").alias("_next"), "_id", "_text")
    return dealt.repartitionById(ranges, "_part").sortWithinPartitions("_part", "_next", F.col("_id").asc_nulls_first(), "_text")


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What edited_fingerprints() returns, from the rows of in_ranges(); the last row of a piece waits for the next piece."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    held: list[tuple[int, bool, int | None, str]] = []

    def emit(rows: list[tuple[int, bool, int | None, str]], final: bool) -> Iterator[pa.RecordBatch]:
        own = digests([r[3].encode() for r in rows])
        pairs = [(i, i + 1) for i in range(len(rows) - 1) if not rows[i][1]]
        if final and rows and not rows[-1][1]:
            pairs.append((len(rows) - 1, -1))
        if not pairs:
            return
        edited, following = [], np.zeros((len(pairs), own.shape[1]), dtype=np.uint8)
        nothing = digests([b""])[0]
        for k, (i, j) in enumerate(pairs):
            text = rows[i][3]
            follows = j >= 0 and rows[i][2] is not None and rows[j][0] == rows[i][0]
            cut = len(text) // 4
            edited.append((text[: len(text) - cut] + (rows[j][3][:cut] if follows else "")).encode())
            following[k] = own[j] if follows else nothing
        mine, theirs = own[[i for i, _ in pairs]], digests(edited)
        at = [rows[i] for i, _ in pairs]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[2] for r in at], pa.int64()), pa.array([len(r[3]) for r in at], pa.int64()),
             pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()), pa.array(as_hex(mine), pa.string()),
             pa.array(as_hex(theirs), pa.string()), pa.array(likeness(mine, theirs), pa.float64()), pa.array(likeness(mine, following), pa.float64())],
            names,
        )

    for batch in batches:
        for piece in pieces(batch, "_text"):
            rows = held + list(zip(*(piece.column(c).to_pylist() for c in ("_part", "_next", "_id", "_text"))))
            yield from emit(rows, False)
            held = rows[-1:]
    yield from emit(held, True)


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last quarter of code points (rounded down) replaced by as many first ones of the next
    document, or all if it has fewer. The next document is that of the next id, the first after the last; rows of one id
    follow one another by their texts. Fingerprints are those of fingerprints(), likenesses those of likeness().

    Texts are shuffled once, by ranges of ids, and handled in order within each; besides them only the first id of
    each range is known to all tasks. A null text counts as empty. A row without an id has no next document: its last quarter goes, and
    near_next compares it with an empty text. An only row is its own next. An empty table gives no rows. Ids are numbers;
    other columns, whatever their names, don't matter.
    """
    rows = in_ranges(docs.select(F.col(id_col).cast("long").alias("_id"), body(text_col).alias("_text")))
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.mapInArrow(_edits, schema)

"""Windows of a fixed number of symbols (bytes or words) as paths between nodes, without a row for every window.

A window of L symbols is an edge of a De Bruijn graph: it leads from the node of its first L - 1 symbols to that of
its last L - 1. Every window is owned by its minimizer, of its k-grams the one with the lowest hash, the first of
equals, so equal windows have equal owners at equal places. Consecutive windows with one owner are a fragment: a
path of n_windows edges from node `head` to node `tail`. It has at most L - k + 1 edges, so both nodes together
cover all of its symbols, and (head, tail, n_windows) stands for its content. Nodes are XXH3 hashes of the symbols
themselves, taken at their source coordinates.

Fragments of a text depend on nothing but the text, so any task finds the same ones however often it runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import pieces
from .common import discard, written

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: The inverse of BASE modulo 2**64.
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
HIGH, LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
PIECE = 1 << 20
#: Bytes of words that are hashed at once.
BLOCK = 1 << 16

FRAGMENTS = "h bigint, head bigint, tail bigint, doc bigint, start int, n_windows int"
#: What names a fragment's content.
KIND = ["h", "head", "tail", "n_windows"]

_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i for i up to n."""
    if len(_powers[0]) <= n:
        for i, base in enumerate((BASE, INVERSE)):
            steps = np.full(max(n, PIECE) + 1, base, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def gram_hashes(values: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all spans of `length` symbols, from prefix sums of a polynomial modulo 2**64."""
    up, down = powers(len(values))
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)))
    n = max(0, len(sums) - length)
    return mixed((sums[length:] - sums[:n]) * down[:n])


@dataclass
class Symbols:
    """The symbols of some texts: a value for each, the number in each text, and where each stands in `data`."""

    values: np.ndarray
    lengths: np.ndarray
    data: bytes
    edges: np.ndarray | None  # None: a symbol is a byte
    gap: int = 0  # bytes between symbols

    def content(self, a: int, b: int) -> bytes:
        if self.edges is None:
            return self.data[a:b]
        return self.data[self.edges[a] : self.edges[b] - self.gap]

    def nodes(self, at: np.ndarray, length: int) -> np.ndarray:
        """The hashes of the nodes of `length` symbols at some places."""
        a, b, data, digest = at, at + length, self.data, xxhash.xxh3_64_intdigest
        if self.edges is not None:
            a, b = self.edges[a], self.edges[b] - self.gap
        return np.fromiter((digest(data[i:j]) for i, j in zip(a.tolist(), b.tolist())), dtype=np.uint64, count=len(at))


_byte_values = np.random.default_rng(11).integers(0, 1 << 64, 256, dtype=np.uint64)


def byte_symbols(texts: list[str]) -> Symbols:
    """The UTF-8 bytes of texts."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = b"".join(raw)
    return Symbols(_byte_values[np.frombuffer(data, dtype=np.uint8)], np.array([len(r) for r in raw], dtype=np.int64), data, None)


#: The ASCII white space besides the space itself, made spaces.
_spaces = bytes.maketrans(b"\t\n\v\f\r", b"     ")


def word_values(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A hash for each of data[edges[i] : edges[i + 1]], by prefix sums over blocks of whole words."""
    out, i = np.empty(len(edges) - 1, dtype=np.uint64), 0
    while i < len(out):
        j = max(i + 1, int(np.searchsorted(edges, edges[i] + BLOCK, side="right")) - 1)
        block, at = data[edges[i] : edges[j]], edges[i : j + 1] - edges[i]
        up, down = powers(len(block))
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_byte_values[block] * up[: len(block)], dtype=np.uint64)))[at]
        out[i:j] = mixed((sums[1:] - sums[:-1]) * down[at[:-1]])
        i = j
    return out


def word_symbols(texts: list[str]) -> Symbols:
    """The words [^\\x20\\x09-\\x0D]+ of texts in UTF-8; content() has one space between words.

    Values only choose minimizers, so two words may share one; nodes are taken of the words themselves.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer((b" ".join(raw) + b" ").translate(_spaces), dtype=np.uint8)
    space = data == 32
    ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1  # the space after each word; others go
    kept = ~space
    kept[ends] = True
    upto = np.searchsorted(ends, np.cumsum([len(r) + 1 for r in raw], dtype=np.int64))
    data = data[kept]
    edges = np.concatenate((np.zeros(1, dtype=np.int64), np.flatnonzero(data == 32) + 1))
    return Symbols(word_values(data, edges), np.diff(upto, prepend=0), data.tobytes(), edges, 1)


Reader = Callable[[list[str]], Symbols]


def fragments_of(s: Symbols, window: int, k: int):
    """(text, place in all symbols, n_windows, minimizer hash) of every fragment."""
    n, w = len(s.values), window - k + 1
    ends = np.cumsum(s.lengths)
    if n < window:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.view(np.uint64)
    grams = gram_hashes(s.values, k)
    # Lowest hash, then lowest place, over w k-grams in a row, by doubling.
    low, span = (grams & HIGH) | np.arange(len(grams), dtype=np.uint64), 1
    while span * 2 <= w:
        low, span = np.minimum(low[:-span], low[span:]), span * 2
    if span < w:
        low = np.minimum(low[: len(low) - (w - span)], low[w - span :])
    owner = (low & LOW).astype(np.int64)
    text_end = np.repeat(ends, s.lengths)[: len(owner)]
    inside = np.arange(len(owner)) + window <= text_end
    first = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1]))))
    count = np.diff(np.append(first, len(owner)))
    first, count = first[inside[first]], count[inside[first]]
    return np.searchsorted(ends, first, side="right"), first, count, grams[owner[first]]


def _batch(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def candidates(docs: DataFrame, read: Reader, window: int, k: int) -> DataFrame:
    """FRAGMENTS rows of docs(doc, text), a written table: all whose minimizer stands in several places.

    Minimizers are counted first, combined in pieces of text and on the map side; then the fragments are made
    again, which is cheaper than keeping them, and joined with the minimizers that repeat. Both sides of that join
    come straight from a shuffle, so Spark splits a frequent minimizer. Rows without an id are left out.
    """

    def minimizers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                h, n = np.unique(fragments_of(read(piece.column("text").to_pylist()), window, k)[3], return_counts=True)
                yield _batch([h.view(np.int64), n], ["h", "n"])

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                s = read(piece.column("text").to_pylist())
                text, first, count, h = fragments_of(s, window, k)
                at = np.unique(np.concatenate((first, first + count)))
                nodes = s.nodes(at, window - 1).view(np.int64)
                start = first - (np.cumsum(s.lengths) - s.lengths)[text]
                yield _batch(
                    [
                        h.view(np.int64), nodes[np.searchsorted(at, first)], nodes[np.searchsorted(at, first + count)],
                        piece.column("doc").to_numpy()[text], start.astype(np.int32), count.astype(np.int32),
                    ],
                    ["h", "head", "tail", "doc", "start", "n_windows"],
                )

    own = docs.filter("doc IS NOT NULL")
    met = own.mapInArrow(minimizers, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    met = written(met.filter("n > 1").select("h"))
    out = written(own.mapInArrow(paths, FRAGMENTS).join(met, "h", "left_semi"))
    discard(met)
    return out


def kinds_of(fragments: DataFrame) -> DataFrame:
    """One row for each content of fragments, a written table: KIND, its number n, and doc and start of the smallest
    occurrence."""
    one = F.min(F.struct("doc", "start"))
    k = fragments.groupBy(*KIND).agg(F.count(F.lit(1)).alias("n"), one.alias("one"))
    return written(k.select(*KIND, "n", "one.doc", "one.start"))


def packed(docs: DataFrame) -> DataFrame:
    """docs(doc, text) as (doc, z) with the text compressed, for shuffles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                z = [squeeze(t.encode("utf-8", "surrogatepass")) for t in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column("doc"), pa.array(z, pa.binary())], ["doc", "z"])

    return docs.mapInArrow(run, "doc bigint, z binary")


def unpacked_bytes(piece: pa.RecordBatch) -> list[bytes]:
    grow = zstandard.ZstdDecompressor().decompress
    return [grow(z) for z in piece.column("z").to_pylist()]


def unpacked(piece: pa.RecordBatch) -> list[str]:
    return [raw.decode("utf-8", "surrogatepass") for raw in unpacked_bytes(piece)]


#: emit(symbols of some texts, arrays doc, place in all symbols, start, n_windows, n, h, head, tail) to columns
Emit = Callable[..., list]


def contents(docs: DataFrame, kinds: DataFrame, read: Reader, window: int, emit: Emit, schema: str) -> DataFrame:
    """emit() over each of `kinds` and the text of its smallest occurrence.

    Texts meet the places wanted in them by document. A place is used only if both nodes there are those of its
    kind: of several texts under one id only the right one counts.
    """
    ref = F.struct("start", "n_windows", "n", "h", "head", "tail")
    refs = kinds.groupBy("doc").agg(F.collect_list(ref).alias("refs"))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "z", PIECE // 4):
                s = read(unpacked(piece))
                lists = piece.column("refs")
                size, flat = lists.value_lengths().to_numpy(), lists.flatten()
                start, n_windows, n, h, head, tail = (flat.field(i).to_numpy() for i in range(6))
                text = np.repeat(np.arange(len(size)), size)
                at = start + (np.cumsum(s.lengths) - s.lengths)[text]
                ok = np.flatnonzero(start + n_windows + window - 1 <= s.lengths[text])
                same = (s.nodes(at[ok], window - 1).view(np.int64) == head[ok]) & (s.nodes(at[ok] + n_windows[ok], window - 1).view(np.int64) == tail[ok])
                ok = ok[same]
                doc = piece.column("doc").to_numpy()[text]
                yield _batch(emit(s, *(x[ok] for x in (doc, at, start, n_windows, n, h, head, tail))), names)

    return packed(docs.filter("doc IS NOT NULL")).join(refs, "doc").mapInArrow(run, schema)


EDGES = "head bigint, tail bigint, doc bigint, start int, off int, n bigint"


def edges_of(window: int) -> Emit:
    """EDGES rows: every window of each kind as an edge between nodes, with the kind's number and source coordinates."""

    def emit(s: Symbols, doc, at, start, n_windows, n, h, head, tail) -> list:
        from .arrow import ranges

        nodes = s.nodes(ranges(at, n_windows + 1), window - 1).view(np.int64)
        row = np.repeat(np.arange(len(at)), n_windows)
        last = np.cumsum(n_windows + 1) - 1
        inner = np.ones(len(nodes), dtype=bool)
        inner[last] = False
        first = np.flatnonzero(inner)
        off = ranges(np.zeros(len(at), dtype=np.int64), n_windows).astype(np.int32)
        return [nodes[first], nodes[first + 1], doc[row], start[row].astype(np.int32), off, n[row]]

    return emit


def by_document(docs: DataFrame, spans: DataFrame, *columns: str) -> DataFrame:
    """docs(doc, text) as (doc, z, spans): the spans (start, length, other columns) of each document, null if none.

    Rows without an id go past the join, so they don't meet in one task.
    """
    own = spans.groupBy("doc").agg(F.collect_list(F.struct("start", "length", *columns)).alias("spans"))
    z = packed(docs.filter("doc IS NOT NULL")).join(own, "doc", "left")
    none = F.lit(None).cast(z.schema["spans"].dataType)
    return z.unionByName(packed(docs.filter("doc IS NULL")).withColumn("spans", none))


def covered(length: int, starts, lengths) -> np.ndarray:
    """Which of `length` symbols the spans cover."""
    change = np.zeros(length + 1, dtype=np.int64)
    np.add.at(change, np.minimum(starts, length), 1)
    np.add.at(change, np.minimum(np.asarray(starts) + lengths, length), -1)
    return np.cumsum(change[:-1]) > 0

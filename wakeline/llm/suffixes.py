"""Suffix-array dedup of byte strings: maximal repeats from enhanced suffix arrays.

Suffixes are dealt by the minimizer of their first `least` bytes, so equal strings of that length meet. A bucket has
the fragments (fragments.py) of one minimizer; equal ones stand in its array once, with their number. It sorts its
suffixes by their bytes, computes the common prefixes of neighbours and scans them with a stack: every interval of
the common-prefix tree whose members are preceded by different bytes (or begin a fragment) is a maximal repeat, and so
is a leaf that stands for several equal fragments. Joins by fragment lead from the members of an interval to all
their occurrences in the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fragments
from .arrow import pieces, ranges, runs
from .common import written
from .fragments import KIND, mixed

MINIMIZER = 24
#: Kinds of fragments that one task searches together. A crowded minimizer has more and is settled window by window in joins.
BUCKET = 20_000
CONTENTS = "h bigint, head bigint, tail bigint, n_windows int, n bigint, doc bigint, start int, content binary"
#: Members of intervals: a suffix of a kind of fragment, with the smallest occurrence of the repeat.
MEMBERS = "grp bigint, h bigint, head bigint, tail bigint, n_windows int, offset int, length int, first_doc bigint, first_start int"
#: Spans of smallest occurrences that repeat something smaller.
SPANS = "doc bigint, start int, length int"


def content_of(least: int) -> fragments.Emit:
    def emit(s: fragments.Symbols, doc, at, start, n_windows, n, h, head, tail) -> list:
        content = [s.content(a, b) for a, b in zip(at.tolist(), (at + n_windows + least - 1).tolist())]
        return [h, head, tail, n_windows, n, doc, start, pa.array(content, pa.binary())]

    return emit


def intervals(lcp: list[int], rank: list[int], left: list[int]) -> list[tuple[int, int, int, int]]:
    """(length, from, to, smallest rank) of the maximal repeats of an enhanced suffix array.

    lcp[i] is the common prefix of suffixes i - 1 and i (0 at both ends), rank the order of the suffixes in
    the corpus, left the byte before each. The stack holds the open intervals, each with its smallest rank
    and its common left byte, -1 once there are several: only such an interval can't be extended to the left.
    """
    out, stack = [], []
    for i in range(1, len(rank) + 1):
        now = lcp[i]
        begin, best, before = i - 1, rank[i - 1], left[i - 1]
        while stack and stack[-1][0] > now:
            length, lb, b, e = stack.pop()
            best = b if b < best else best
            before = e if e == before else -1
            begin = lb
            if before == -1:
                out.append((length, lb, i - 1, best))
        if now:
            if stack and stack[-1][0] == now:
                top = stack[-1]
                if best < top[2]:
                    top[2] = best
                if top[3] != before:
                    top[3] = -1
            else:
                stack.append([now, begin, best, before])
    return out


def merged_spans(doc: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
    """The spans by document, those that overlap or touch as one."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], (start + length)[order]
    if len(doc):
        # Spans of all documents on one line, far enough apart.
        shift = np.cumsum(np.concatenate(([0], np.diff(doc) != 0))).astype(np.int64) << 40
        reach = np.maximum.accumulate(end + shift)
        first = np.flatnonzero(np.concatenate(([True], start[1:] + shift[1:] > reach[:-1])))
        last = np.append(first[1:], len(doc)) - 1
        doc, start, end = doc[first], start[first], reach[last] - shift[last]
    arrays = [pa.array(x) for x in (doc.astype(np.int64), start.astype(np.int32), (end - start).astype(np.int32))]
    return pa.RecordBatch.from_arrays(arrays, ["doc", "start", "length"])


def bucket_repeats(least: int, spans_only: bool):
    """Maximal repeats of `least` bytes or more among the fragments of each bucket: MEMBERS rows, or with spans_only
    the SPANS of the kinds' smallest occurrences that are not the first of a repeat, those that meet as one."""

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        h, head, tail, size, n, doc, start = (rows.column(c).to_numpy() for c in (*KIND, "n", "doc", "start"))
        text = rows.column("content").to_pylist()
        # Rows of docs that repeat as a whole give the same fragment several times.
        order = np.lexsort((start, doc, h))
        twice = (np.diff(h[order]) == 0) & (np.diff(doc[order]) == 0) & (np.diff(start[order]) == 0)
        if twice.any():
            own = np.sort(order[np.concatenate(([True], ~twice))])
            h, head, tail, size, n, doc, start = (x[own] for x in (h, head, tail, size, n, doc, start))
            text = [text[i] for i in own.tolist()]
        kinds = (h, head, tail, size, doc, start)
        length = size.astype(np.int64) + least - 1
        offset = np.cumsum(length) - length
        flat = np.frombuffer(b"".join(text) + bytes(least + 16), dtype=np.uint8)
        words = np.ndarray((len(flat) - 7,), dtype=">u8", buffer=flat, strides=(1,))
        # Leaves of several equal fragments are repeats, unless an interval has them whole.
        leaf = n > 1
        yield from search(kinds, offset, length, flat, words, leaf)
        row = np.flatnonzero(leaf)
        if len(row) and not spans_only:
            yield members(kinds, row, np.zeros(len(row), dtype=np.int64), length[row], doc[row], start[row])

    def members(kinds, row, offset, length, first_doc, first_start) -> pa.RecordBatch:
        # A repeat is named by its minimizer, first occurrence and length.
        h = kinds[0]
        name = mixed(mixed(h[row].view(np.uint64) ^ mixed(first_doc.view(np.uint64))) + (length.astype(np.uint64) << np.uint64(32)) + first_start.astype(np.uint64))
        columns = [name.view(np.int64), *(x[row] for x in kinds[:4]), offset.astype(np.int32), length.astype(np.int32), first_doc, first_start.astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], [c.split()[0] for c in MEMBERS.split(", ")])

    def search(kinds, offset, length, flat, words, leaf) -> Iterator[pa.RecordBatch]:
        h, _, _, size, _, _ = kinds
        at = ranges(offset, size)
        row = np.repeat(np.arange(len(h)), size)
        kind = np.cumsum(np.concatenate(([True], h[1:] != h[:-1])))[row] if len(h) else row
        # Sort by eight bytes at a time; suffixes that share their first bytes with no other drop out.
        for depth in range(0, least, 8):
            word = words[at + depth].astype(np.uint64)
            if least - depth < 8:
                word >>= np.uint64(8 * (8 - (least - depth)))
            order = np.lexsort((word, kind))
            at, row, kind, word = at[order], row[order], kind[order], word[order]
            new = np.concatenate(([True], (kind[1:] != kind[:-1]) | (word[1:] != word[:-1]))) if len(at) else np.zeros(0, bool)
            kind = np.cumsum(new)
            shared = np.bincount(kind)[kind] > 1 if len(at) else new
            at, row, kind = at[shared], row[shared], kind[shared]
            if not len(at):
                return
        begins = at == offset[row]
        left = np.where(begins, 256 + row, flat[at - 1].astype(np.int64))
        # A top interval with one left byte has no maximal repeat in it.
        head = runs(kind)
        several = np.minimum.reduceat(left, head) != np.maximum.reduceat(left, head)
        keep = np.repeat(several, np.diff(np.append(head, len(kind))))
        at, row, kind, left = at[keep], row[keep], kind[keep], left[keep]
        if not len(at):
            return
        # What follows the first `least` bytes, up to the fragment's end, orders the rest.
        rest = (offset + length)[row] - at - least
        most = max(8, -(-int(rest.max() + 1) // 8) * 8)
        for part in np.array_split(np.arange(len(head[several])), max(1, len(at) // 50_000)):
            if not len(part):
                continue
            heads = np.append(runs(kind), len(kind))
            s = slice(heads[part[0]], heads[part[-1] + 1])
            yield from scan(at[s], row[s], kind[s], left[s], rest[s], most, flat, offset, length, kinds, leaf)

    def scan(at, row, kind, left, rest, most, flat, offset, length, kinds, leaf) -> Iterator[pa.RecordBatch]:
        doc, start = kinds[4:]
        tail = flat[np.minimum(at[:, None] + least + np.arange(most), len(flat) - 1)]
        tail = np.where(np.arange(most) < rest[:, None], tail, 0).astype(np.uint8)
        keys = tail.view(">u8").astype(np.uint64)
        order = np.lexsort((rest, *keys.T[::-1], kind))
        at, row, kind, left, rest, tail = (x[order] for x in (at, row, kind, left, rest, tail))
        differ = tail[1:] != tail[:-1]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), most)
        lcp = np.where(kind[1:] == kind[:-1], least + np.minimum(same, np.minimum(rest[1:], rest[:-1])), 0)
        place = start[row] + at - offset[row]
        rank = np.empty(len(at), dtype=np.int64)
        by_place = np.lexsort((place, doc[row]))
        rank[by_place] = np.arange(len(at))
        found = intervals([0, *lcp.tolist(), 0], rank.tolist(), left.tolist())
        if not found:
            return
        f = np.array(found)
        count = f[:, 2] - f[:, 1] + 1
        within = ranges(f[:, 1], count)
        long = np.repeat(f[:, 0], count)
        whole = (long == length[row[within]]) & (at[within] == offset[row[within]])
        leaf[row[within[whole]]] = False
        first = rank[within] == np.repeat(f[:, 3], count)
        if spans_only:
            yield merged_spans(doc[row[within]][~first], place[within][~first], long[~first])
            return
        best = np.repeat(by_place[f[:, 3]], count)
        yield members(kinds, row[within], (at - offset[row])[within], long, doc[row[best]], place[best])

    return work


def by_bucket(rows: DataFrame, work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, most: int = 15_000) -> DataFrame:
    """work() on tables of whole buckets (equal h), of about `most` rows, in each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            h = batch.column("h").to_numpy()
            if size < most or h[0] == h[-1]:
                continue
            cut = int(np.searchsorted(h, h[-1]))
            held[-1] = batch.slice(0, cut)
            yield from work(pa.Table.from_batches(held))
            held, size = [batch.slice(cut)], batch.num_rows - cut
        if held:
            yield from work(pa.Table.from_batches(held))

    return rows.repartition("h").sortWithinPartitions("h").mapInArrow(run, schema)


def crowded_windows(docs: DataFrame, places: DataFrame, least: int) -> DataFrame:
    """(grp, doc, start, length, first): every repeated window of `least` bytes at the places given, by itself.

    For minimizers with so many kinds of fragments that no task should hold them: windows are named by their nodes,
    counted with a map-side combine and joined back.
    """
    each = fragments.contents(docs, places, fragments.byte_symbols, least, fragments.edges_of(least), fragments.EDGES)
    each = each.select("head", "tail", "doc", (F.col("start") + F.col("off")).alias("start"), "n")
    met = each.groupBy("head", "tail").agg(F.sum("n").alias("met"), F.min(F.struct("doc", "start")).alias("first"))
    is_first = (F.col("doc") == F.col("first.doc")) & (F.col("start") == F.col("first.start"))
    found = each.join(met.filter("met > 1"), ["head", "tail"])
    return found.select(F.xxhash64("head", "tail").alias("grp"), "doc", "start", F.lit(least).alias("length"), is_first.alias("first"))


def _prepared(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fragments that may repeat, their kinds, and minimizers (h) of several kinds, crowded if more than BUCKET; written
    tables."""
    found = fragments.candidates(docs, fragments.byte_symbols, least, MINIMIZER)
    kinds = fragments.kinds_of(found)
    several = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    return found, kinds, written(several.select("h", (F.col("kinds") > BUCKET).alias("crowded")))


def maximal_repeats(docs: DataFrame, least: int) -> DataFrame:
    """(grp, doc, start, length, first) of docs(doc, text): the repeats of `least` bytes or more, each with all occurrences.

    first marks the smallest (doc, start). A repeat is maximal within the fragments that hold it (less than twice
    `least` bytes); a longer string appears as one repeat for each of its minimizers, which overlap and cover it.
    Minimizers of more than BUCKET kinds give their repeated windows of `least` bytes, with all occurrences too.
    """
    found, kinds, several = _prepared(docs, least)
    crowds = several.filter("crowded").select("h")
    some = fragments.contents(docs, kinds.join(crowds, "h", "left_anti"), fragments.byte_symbols, least, content_of(least), CONTENTS)
    groups = by_bucket(some, bucket_repeats(least, False), MEMBERS)
    every = groups.join(found, KIND).withColumn("at", F.col("start") + F.col("offset"))
    is_first = (F.col("doc") == F.col("first_doc")) & (F.col("at") == F.col("first_start"))
    every = every.select("grp", "doc", F.col("at").alias("start"), "length", is_first.alias("first"))
    places = found.join(crowds, "h", "left_semi").withColumn("n", F.lit(1).cast("long"))
    return every.unionByName(crowded_windows(docs, places, least)).distinct()


def removed_spans(docs: DataFrame, least: int) -> DataFrame:
    """SPANS of docs(doc, text) that repeat something smaller, as maximal_repeats() finds them.

    The arrays decide on the smallest occurrence of each kind of fragment; of a kind that occurs several times all
    others go whole, as its leaf says. The array of a minimizer with one kind is that leaf, and needs no bytes.
    """
    found, kinds, several = _prepared(docs, least)
    of = lambda crowded: kinds.join(several.filter(F.col("crowded") == crowded).select("h"), "h", "left_semi")
    some = fragments.contents(docs, of(False), fragments.byte_symbols, least, content_of(least), CONTENTS)
    searched = by_bucket(some, bucket_repeats(least, True), SPANS)
    single = crowded_windows(docs, of(True), least).filter("NOT first").select("doc", "start", "length")
    leaves = kinds.filter("n > 1").select(*KIND, F.struct("doc", "start").alias("first"))
    copies = found.join(leaves, KIND).filter(F.struct("doc", "start") != F.col("first"))
    copies = copies.select("doc", "start", (F.col("n_windows") + (least - 1)).alias("length"))
    return copies.unionByName(searched).unionByName(single)


def remove_repeats(docs: DataFrame, least: int = 100, id_col="doc_id", text_col="text", digests: bool = False) -> DataFrame:
    """One row for each input row: doc_id, n_bytes, n_removed, n_spans, and kept (binary), or with digests kept_sha256.

    Each UTF-8 byte in a string of `least` bytes that also starts earlier (smaller id, or before in the same
    text) goes; strings are judged on the input, overlaps count. n_spans: maximal removed runs.

    Ids are numbers. A null text is empty. Rows with a null id are returned whole and don't count as occurrences.
    Repeated rows with one id and one text are one document; of different texts under one id the spans of all are
    taken from each. Texts shorter than `least` are returned whole. An empty table gives no rows; other columns don't
    matter.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marked = fragments.by_document(d, removed_spans(d, least))
    name = "kept_sha256" if digests else "kept"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "z", fragments.PIECE // 4):
                total, removed, n_spans, kept = [], [], [], []
                lists = piece.column("spans")
                size, flat = lists.value_lengths().fill_null(0).to_numpy(), lists.flatten()
                starts, lengths = flat.field(0).to_numpy(), flat.field(1).to_numpy()
                end = 0
                for raw, n in zip(fragments.unpacked_bytes(piece), size.tolist()):
                    own, end = slice(end, end + n), end + n
                    gone = spans_ = 0
                    rest = raw
                    if n:
                        cover = fragments.covered(len(raw), starts[own], lengths[own])
                        gone = int(cover.sum())
                        spans_ = int(cover[:1].sum() + (cover[1:] & ~cover[:-1]).sum())
                        rest = np.frombuffer(raw, dtype=np.uint8)[~cover].tobytes()
                    total.append(len(raw))
                    removed.append(gone)
                    n_spans.append(spans_)
                    kept.append(hashlib.sha256(rest).hexdigest() if digests else rest)
                columns = [pa.array(x, pa.int64()) for x in (total, removed, n_spans)]
                columns = [piece.column("doc"), *columns, pa.array(kept, pa.string() if digests else pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", name])

    kind = "string" if digests else "binary"
    return marked.mapInArrow(run, f"doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, {name} {kind}")

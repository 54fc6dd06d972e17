"""Substring dedup over words: a compacted De Bruijn graph of repeated word windows.

Nodes are sequences of window - 1 words, edges the windows. Fragments (fragments.py) are paths of edges. Where all
fragments of a minimizer are alike, none of their edges is in any other path, so their number is that of each edge.
Where they differ, their edges are dealt out by their nodes and counted one by one. What repeats, whole fragments
and runs of edges within others, are the pieces of the graph. A node at which one piece ends and one begins does not
branch; pieces that meet there are joined into one passage by pointer doubling, a join for each doubling. Source
coordinates lead from passages to the spans of documents, and the words there are compared with the passage's nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import fragments
from .arrow import pieces
from .common import discard, written

MINIMIZER = 8
PATH = ["head", "tail", "n_windows"]


def repeated_runs(docs: DataFrame, kinds: DataFrame, window: int) -> DataFrame:
    """(doc, start, n_windows, head, tail), a written table: runs of repeated edges in fragments that are alone of
    their kind but share their minimizer with others.

    Edges are counted by their two nodes with a map-side combine, and joined back to those that may be part of a
    run, so a frequent window needs no task of its own. A run lies in one fragment.
    """
    # Written, so that Spark can split a frequent minimizer in the join.
    several = written(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("h"))
    mixed = kinds.join(several, "h", "left_semi")
    edges = written(fragments.contents(docs, mixed, fragments.word_symbols, window, fragments.edges_of(window), fragments.EDGES))
    met = edges.groupBy("head", "tail").agg(F.sum("n").alias("met")).filter("met > 1").select("head", "tail")
    hits = edges.filter("n = 1").join(met, ["head", "tail"], "left_semi")
    line = W.partitionBy("doc", "start").orderBy("off")
    new = F.coalesce(F.col("off") - F.lag("off").over(line) > 1, F.lit(True)).cast("int")
    hits = hits.withColumn("new", new).withColumn("run", F.sum("new").over(line))
    runs = written(
        hits.groupBy("doc", "start", "run")
        .agg(
            F.min("off").alias("off"), F.count(F.lit(1)).cast("int").alias("n_windows"),
            F.min_by("head", "off").alias("head"), F.max_by("tail", "off").alias("tail"),
        )
        .select("doc", (F.col("start") + F.col("off")).alias("start"), *PATH)
    )
    discard(edges, several)
    return runs


def compacted(paths: DataFrame) -> DataFrame:
    """paths(head, tail, n_windows), distinct pieces, with passage and ahead, a written table.

    In- and out-degrees are counts by node. Each piece points to the next one where the node between them has one
    of either; pointers then double until they reach a last piece, which names the passage. ahead: edges from the
    piece's begin to the last one's. When a round brings none further, what is left goes round in circles, and those
    pieces stay by themselves.
    """
    p = written(paths.distinct().withColumn("piece", F.xxhash64(*PATH)))
    degree = lambda node, name: (
        p.groupBy(F.col(node).alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("piece").alias(name)).filter("n = 1").drop("n")
    )
    joints = degree("tail", "before").join(degree("head", "after"), "node").filter("before <> after").select("before", "after")
    links = p.select("piece", "n_windows").join(joints, F.col("piece") == F.col("before"))
    links = links.select("piece", F.col("after").alias("to"), F.col("n_windows").cast("long").alias("ahead"))
    ends = joints.select(F.col("after").alias("piece")).join(joints.select(F.col("before").alias("piece")), "piece", "left_anti")
    s = links.withColumn("done", F.lit(False)).unionByName(
        ends.select("piece", F.col("piece").alias("to"), F.lit(0).cast("long").alias("ahead"), F.lit(True).alias("done"))
    )
    s, left = written(s), -1
    while (now := s.filter("NOT done").count()) not in (0, left):
        left = now
        further = s.select(F.col("piece").alias("to"), F.col("to").alias("to2"), F.col("ahead").alias("more"), F.col("done").alias("done2"))
        moved = s.filter("NOT done").join(further, "to")
        moved = moved.select("piece", F.col("to2").alias("to"), (F.col("ahead") + F.col("more")).alias("ahead"), F.col("done2").alias("done"))
        before, s = s, written(s.filter("done").unionByName(moved))
        discard(before)
    s = s.filter("done").select("piece", F.col("to").alias("passage"), "ahead")
    out = p.join(s, "piece", "left").select(
        *PATH, F.coalesce("passage", "piece").alias("passage"), F.coalesce("ahead", F.lit(0)).alias("ahead")
    )
    return written(out)


def repeated_passages(docs: DataFrame, window: int) -> DataFrame:
    """(passage, place, doc, start, length, first, last): every span of docs(doc, text), in words, all of whose windows
    start elsewhere too.

    passage names a compacted path; spans of it with equal start - place would be aligned. first and last are the
    nodes at the span's ends. Spans of different passages overlap by window - 1 words where they follow one another.
    """
    found = fragments.candidates(docs, fragments.word_symbols, window, MINIMIZER)
    kinds = fragments.kinds_of(found)
    runs = repeated_runs(docs, kinds, window)
    graph = compacted(kinds.filter("n > 1").select(*PATH).unionByName(runs.select(*PATH)))
    places = found.select("doc", "start", *PATH).unionByName(runs.select("doc", "start", *PATH))
    places = places.join(graph, PATH).select(
        "doc", "start", "head", "tail", "passage",
        (F.col("start") + F.col("ahead")).alias("place"), (F.col("start") + F.col("n_windows")).alias("end"),
    )
    line = W.partitionBy("doc", "passage", "place").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    places = places.withColumn("new", F.coalesce(F.col("start") > F.max("end").over(line), F.lit(True)).cast("int"))
    upto = W.partitionBy("doc", "passage", "place").orderBy("start", "end").rowsBetween(W.unboundedPreceding, W.currentRow)
    spans = places.withColumn("run", F.sum("new").over(upto)).groupBy("doc", "passage", "place", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("head", "start").alias("first"), F.max_by("tail", "end").alias("last")
    )
    return spans.select("passage", "place", "doc", "start", (F.col("end") - F.col("start") + (window - 1)).cast("int").alias("length"), "first", "last")


def remove_passages(docs: DataFrame, window: int = 35, id_col="doc_id", text_col="text", digests: bool = False) -> DataFrame:
    """One row for each input row: doc_id, n_words, n_removed, and kept_text, or with digests kept_sha256.

    Words are runs of anything but ASCII white space. Each word in a window whose words also start anywhere
    else goes, the first occurrence too; windows are judged on the input. What stays is joined by one space. A span
    is taken out only where the words at its coordinates hash to its passage's nodes.

    Ids are numbers. A null text has no words. Rows with a null id are returned whole and don't count as occurrences.
    Repeated rows of one id are occurrences of each other; of different texts under one id each loses its own spans.
    Texts of fewer words than a window are returned whole. An empty table gives no rows; other columns don't matter.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marked = fragments.by_document(d, repeated_passages(d, window), "first", "last")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "z", fragments.PIECE // 4):
                texts = fragments.unpacked(piece)
                s = fragments.word_symbols(texts)
                lists = piece.column("spans")
                size, flat = lists.value_lengths().fill_null(0).to_numpy(), lists.flatten()
                start, length, first, last = (flat.field(i).to_numpy() for i in range(4))
                text, base = np.repeat(np.arange(len(size)), size), np.cumsum(s.lengths) - s.lengths
                ok = np.flatnonzero(start + length <= s.lengths[text])
                at = base[text[ok]] + start[ok]
                same = (s.nodes(at, window - 1).view(np.int64) == first[ok]) & (s.nodes(at + length[ok] - window + 1, window - 1).view(np.int64) == last[ok])
                cover = fragments.covered(len(s.values), at[same], length[ok][same])
                gone, size = np.concatenate(([0], np.cumsum(cover))), np.diff(s.edges)
                left = np.frombuffer(s.data, dtype=np.uint8)[np.repeat(~cover, size)].tobytes()
                edges = np.concatenate(([0], np.cumsum(size * ~cover)))
                kept = [left[a : max(a, b - 1)] for a, b in zip(edges[base].tolist(), edges[base + s.lengths].tolist())]
                kept = [hashlib.sha256(k).hexdigest() if digests else k.decode("utf-8", "replace") for k in kept]
                removed = gone[base + s.lengths] - gone[base]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc"), pa.array(s.lengths), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                    ["doc_id", "n_words", "n_removed", name],
                )

    name = "kept_sha256" if digests else "kept_text"
    return marked.mapInArrow(run, f"doc_id bigint, n_words bigint, n_removed bigint, {name} string")

"""SimHash near-dedup: a Gray-order hierarchical index over fingerprints."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import map_pieces, ranges, runs
from .common import masked, unmasked, written
from .components import components

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Blocks into which 64 bits are cut; two fingerprints that differ in d bits agree on BLOCKS - d blocks at least.
BLOCKS = 4
#: Fingerprints of a bucket that one task compares; larger buckets are dealt again by more of their bits, then cut into
#: slices of which each two are compared.
BUCKET = 20_000
#: Children of a node of the index.
FANOUT = 16
#: Pairs of nodes that go down the index together.
SLICE = 8192


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the XXH64 hashes of the word shingles, repeats included."""
    w = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not w:
        return 0
    if len(w) < words:
        w = [b" ".join(w)]
    else:
        w = [b" ".join(s) for s in zip(*(w[i:] for i in range(words)))]
    h = np.array([xxhash.xxh64_intdigest(s, seed) for s in w], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, len(h), 8192):
        ones += np.unpackbits(h[a : a + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) for each row; fp is the fingerprint's 64 bits as a signed long. A null text counts as empty."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            values = [fingerprint(t or "", words, seed) for t in batch.column("_text").to_pylist()]
            fps = pa.array(np.array(values, dtype=np.uint64).view(np.int64))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), fps], ["doc_id", "fp"])

        return each

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    return map_pieces(rows, "_text", make, "doc_id bigint, fp bigint")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each word in the binary-reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def levels(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The index over fingerprints in Gray order: for each level, from the leaves, (pattern, mask) of its nodes.

    Neighbours in Gray order share most bits. A node's mask has the bits on which all fingerprints below it
    agree and its pattern has their values, so what its children share stands once, in the node above.
    """
    out = [(fps, np.full(len(fps), ~np.uint64(0)))]
    while len(out[-1][0]) > 1:
        pattern, mask = out[-1]
        at = np.arange(0, len(pattern), FANOUT)
        ones = np.bitwise_and.reduceat(pattern & mask, at)
        zeros = np.bitwise_and.reduceat(~pattern & mask, at)
        out.append((ones, ones | zeros))
    return out


def merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of the pairs in root, the smallest member of each item's component: minima spread and jump."""
    while True:
        x, y = root[a], root[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (up := root[root])).any():
            root[:] = up


def forest(n: int, pairs) -> np.ndarray:
    """The smallest member of each item's component, from arrays of pairs of items."""
    root = np.arange(n)
    for a, b in pairs:
        merge(root, a, b)
    return root


def common_roots(root: np.ndarray) -> list[np.ndarray]:
    """For each level of the index the root that all fingerprints below a node share, -1 where there are several."""
    out = [root.copy()]
    while len(out[-1]) > 1:
        at = np.arange(0, len(out[-1]), FANOUT)
        low, high = np.minimum.reduceat(out[-1], at), np.maximum.reduceat(out[-1], at)
        out.append(np.where(low == high, low, -1))
    return out


def near_forest(fps: np.ndarray, most: int, close: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """The smallest member of each component of fingerprints, in Gray order, that differ in `most` bits or fewer.

    close(a, b), if given, decides on such pairs. The tree is joined with itself from the root down: two nodes
    whose shared patterns already differ in more bits than allowed are dropped with everything below, and so are
    nodes that lie in one component by now. As neighbours in Gray order are linked first, a group of which
    most are alike is not compared pair by pair. Frontiers go down in slices.
    """
    tree, n = levels(fps), len(fps)
    root = np.arange(n)

    def link(a: np.ndarray, b: np.ndarray) -> None:
        near = np.bitwise_count(fps[a] ^ fps[b]) <= most
        a, b = a[near], b[near]
        if close is not None and len(a):
            near = close(a, b)
            a, b = a[near], b[near]
        merge(root, a, b)

    for lag in range(1, 5):
        link(np.arange(max(0, n - lag)), np.arange(lag, max(n, lag)))
    shared = common_roots(root)
    stack = [(len(tree) - 1, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
    while stack:
        level, a, b = stack.pop()
        if len(a) > SLICE:
            half = len(a) // 2
            stack += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
            continue
        pattern, mask = tree[level]
        near = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= most
        near &= (shared[level][a] != shared[level][b]) | (shared[level][a] < 0)
        a, b = a[near], b[near]
        if level == 0:
            before = root.copy()
            link(a, b)
            if (root != before).any():
                shared = common_roots(root)
        elif len(a):
            below, step = len(tree[level - 1][0]), np.arange(FANOUT)
            x = np.repeat(a[:, None] * FANOUT + step, FANOUT, axis=1).ravel()
            y = np.tile(b[:, None] * FANOUT + step, (1, FANOUT)).ravel()
            real = (x < below) & (y < below) & (x <= y)
            stack.append((level - 1, x[real], y[real]))
    return root


def bucket_links(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that join the near fingerprints of each bucket; rows come sorted by bucket.

    For each bucket a spanning star per component, not all pairs.
    """
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def work(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        starts = runs(keys)
        sizes = np.diff(np.append(starts, len(keys)))
        out_a, out_b = [], []
        # Buckets of two, the most by far, are one comparison each.
        twos = starts[sizes == 2]
        near = np.bitwise_count(fps[twos] ^ fps[twos + 1]) <= most
        out_a.append(fps[twos[near]])
        out_b.append(fps[twos[near] + 1])
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            group = fps[s : s + n]
            group = group[np.argsort(gray_rank(group), kind="stable")]
            root = near_forest(group, most)
            tied = np.flatnonzero(root != np.arange(n))
            out_a.append(group[tied])
            out_b.append(group[root[tied]])
        arrays = [pa.array(np.concatenate(x).view(np.int64)) for x in (out_a, out_b)]
        return pa.RecordBatch.from_arrays(arrays, ["a", "b"])

    for batch in batches:
        keys = batch.column("bucket").to_numpy(zero_copy_only=False)
        fps = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        if not len(keys):
            continue
        held.append((keys, fps))
        if keys[0] == keys[-1] and all(k[0] == keys[0] for k, _ in held):
            continue  # a bucket may go on in the next batch
        keys, fps = (np.concatenate(x) for x in zip(*held))
        cut = np.searchsorted(keys, keys[-1])
        held = [(keys[cut:], fps[cut:])]
        if cut:
            yield work(keys[:cut], fps[:cut])
    if held:
        yield work(*(np.concatenate(x) for x in zip(*held)))


def fingerprint_links(fps: DataFrame, most: int = 2) -> DataFrame:
    """Links (a, b) over distinct fingerprints fps(fp) that connect all pairs within `most` bits.

    Two fingerprints within `most` bits agree on BLOCKS - most of BLOCKS blocks, so each is dealt out by every
    choice of so many blocks, and each bucket is searched with a Gray-order index. A bucket of more than
    BUCKET fingerprints is dealt once more in the same way, by most + 1 parts of its other bits, and what is still
    larger is cut into slices of which each two meet in a cell of their own, so no pair is lost and no task holds
    more than a bucket. most must be below BLOCKS.
    """
    if not 0 <= most < BLOCKS:
        raise ValueError(f"most must be 0 to {BLOCKS - 1}")
    from itertools import combinations

    width = 64 // BLOCKS
    full = 0xFFFFFFFFFFFFFFFF
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    masks = [
        signed(sum(((1 << width) - 1) << (width * i) for i in chosen) & full)
        for chosen in combinations(range(BLOCKS), BLOCKS - most)
    ]
    key = lambda mask: F.xxhash64(F.lit(mask), F.col("fp").bitwiseAND(F.lit(mask)))
    dealt = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(m).alias("mask"), key(m).alias("bucket")) for m in masks])).alias("d"))
    dealt = dealt.select("fp", "d.mask", "d.bucket")
    buckets = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    several = buckets.filter(F.col("n").between(2, BUCKET)).select("bucket")
    work = dealt.join(several, "bucket", "left_semi").select("bucket", "fp")
    large = dealt.join(buckets.filter(F.col("n") > BUCKET).select("bucket"), "bucket", "left_semi")
    # most + 1 interleaved parts of the bits outside the mask: a pair in the bucket agrees on one of them.
    parts = [signed(sum(1 << i for i in range(j, 64, most + 1))) for j in range(most + 1)]
    again = [
        F.xxhash64("bucket", F.lit(j), F.col("fp").bitwiseAND(F.lit(p)).bitwiseAND(F.bitwise_not("mask")))
        for j, p in enumerate(parts)
    ]
    again = large.select(F.explode(F.array(*again)).alias("bucket"), "fp")
    crowds = again.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    slices = F.when(F.col("n") > BUCKET, F.ceil(F.col("n") / max(1, BUCKET // 2))).otherwise(1)
    again = again.join(crowds.select("bucket", slices.alias("slices")), "bucket")
    work = work.unionByName(again.select(cells("bucket", "fp").alias("bucket"), "fp"))
    work = work.repartition("bucket").sortWithinPartitions("bucket")
    return work.mapInArrow(lambda it: bucket_links(it, most), "a bigint, b bigint")


def near_groups(docs: DataFrame, id_col="doc_id", text_col="text", words: int = 3, most: int = 2, seed: int = 42) -> DataFrame:
    """One row for each input row: doc_id, fingerprint (16 hex digits), component_id.

    Documents link where their fingerprints differ in `most` bits or fewer; component_id is the smallest
    doc_id that is reachable. Ids are numbers. Only distinct fingerprints are compared, so copies cost one row, and
    the join back to documents has a hot fingerprint's rows on one side only, which Spark splits. A text without
    words (null or empty too) has fingerprint zero, linked like any other. A null id gets a component, and
    is its smallest member only where the component has no other id. Repeated rows give repeated rows.
    """
    f = written(fingerprints(docs, id_col, text_col, words, seed))
    distinct = f.groupBy("fp").agg(F.min("doc_id").alias("first"))
    linked = components(fingerprint_links(distinct.select("fp"), most))
    named = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left")
    named = named.withColumn("component", F.coalesce("component", "fp"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of = named.join(smallest, "component").select("fp", "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return f.join(of, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


#: 64-bit lanes of a wide fingerprint, and minimum-shingle keys that deal documents out.
LANES, KEYS = 8, 6
#: Documents that one task compares; larger buckets are cut into slices, of which each two are compared.
NEAR_BUCKET = 4096
#: Shingles of a slice of similar documents, and of sets that are counted together.
MEMBERS = 2_000_000


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles, in order; none for a text without words."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not w:
        return np.zeros(0, dtype=np.uint64)
    shingles = {b" ".join(w[j : j + words]) for j in range(max(1, len(w) - words + 1))}
    return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(s) for s in shingles), dtype=np.uint64, count=len(shingles)))


def wide_fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(sets, LANES) fingerprints of sets of shingle hashes and (sets, KEYS) minimum shingle hashes."""
    from .fragments import mixed

    seeds = np.random.default_rng(23).integers(0, 1 << 63, LANES + KEYS, dtype=np.uint64)
    wide, keys = np.zeros((len(sets), LANES), dtype=np.uint64), np.zeros((len(sets), KEYS), dtype=np.uint64)
    for i, h in enumerate(sets):
        if not len(h):
            continue
        for j in range(KEYS):
            keys[i, j] = mixed(h ^ seeds[LANES + j]).min()
        ones = np.zeros(64 * LANES, dtype=np.int64)
        for a in range(0, len(h), 2048):
            lanes = np.stack([mixed(h[a : a + 2048] ^ s) for s in seeds[:LANES]], axis=1)
            ones += np.unpackbits(lanes.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
        wide[i] = np.packbits(ones * 2 > len(h)).view(np.uint64)
    return wide, keys


def bits_apart(similarity: float) -> float:
    """The expected share of differing bits of two large shingle sets with this Jaccard similarity, at most.

    Sets of equal size differ most.
    """
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def in_common(flat: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of common members of each pair of sets; set i is flat[ends[i]:ends[i + 1]], small numbers."""
    out = np.zeros(len(a), dtype=np.int64)
    if not len(a):
        return out
    held = np.zeros(int(flat.max(initial=0)) + 1, dtype=bool)
    order = np.argsort(a, kind="stable")
    size = np.diff(ends)
    # Pairs of one set together, of about MEMBERS members at most.
    part = np.cumsum(size[b[order]]) // MEMBERS
    starts = np.flatnonzero(np.concatenate(([True], (np.diff(a[order]) != 0) | (np.diff(part) != 0))))
    for pairs in np.split(order, starts[1:]):
        own = flat[ends[a[pairs[0]]] : ends[a[pairs[0]] + 1]]
        held[own] = True
        others = size[b[pairs]]
        hits = np.concatenate(([0], np.cumsum(held[flat[ranges(ends[b[pairs]], others)]], dtype=np.int64)))
        upto = np.cumsum(others)
        out[pairs] = hits[upto] - hits[upto - others]
        held[own] = False
    return out


def similar_links(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of each bucket's similar documents, to the first of each component; rows sorted by bucket.

    The Gray-order index over the first lane finds pairs with few enough differing bits, and all lanes together
    decide on candidates. Both bounds are three standard errors above a share of bits that is a quarter over
    bits_apart(), as majorities of few shingles are coarse: with four of five shingles in common 3/16 of the
    bits differ. If the rows have `shingles`, only candidates whose sets are similar by count link.
    """
    p = min(0.5, 1.25 * bits_apart(similarity))
    first = int(64 * p + 3 * np.sqrt(64 * p * (1 - p)))
    total = 64 * LANES * p + 3 * np.sqrt(64 * LANES * p * (1 - p))

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket, ids = t.column("bucket").to_numpy(), t.column("id").to_numpy()
        wide = np.frombuffer(b"".join(t.column("wide").to_pylist()), dtype=np.uint64).reshape(-1, LANES)
        exact = "shingles" in t.column_names
        if exact:
            lists = t.column("shingles").combine_chunks()
            members = lists.flatten().to_numpy()
            upto = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(), dtype=np.int64)))
        starts = runs(bucket)
        out_a, out_b = [], []
        for s, n in zip(starts.tolist(), np.diff(np.append(starts, len(bucket))).tolist()):
            order = np.argsort(gray_rank(wide[s : s + n, 0]), kind="stable") + s
            if exact:
                flat = np.unique(members[upto[s] : upto[s + n]], return_inverse=True)[1]
                ends = upto[s : s + n + 1] - upto[s]
                size = np.diff(ends)

            def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                near = np.bitwise_count(wide[order[a]] ^ wide[order[b]]).sum(axis=1) <= total  # noqa: B023
                if exact:
                    x, y = order[a] - s, order[b] - s  # noqa: B023
                    near &= np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y]) - 1  # noqa: B023
                    at = np.flatnonzero(near & (x != y))
                    x, y = x[at], y[at]
                    common = in_common(flat, ends, x, y)  # noqa: B023
                    near[at] = common / np.maximum(1, size[x] + size[y] - common) >= similarity  # noqa: B023
                return near

            root = near_forest(wide[order, 0], first, close)
            tied = np.flatnonzero(root != np.arange(n))
            out_a.append(ids[order[tied]])
            out_b.append(ids[order[root[tied]]])
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_a, out_b)], ["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket = batch.column("bucket").to_numpy()
        cut = int(np.searchsorted(bucket, bucket[-1]))
        if cut == 0 and (not held or held[0].column("bucket")[0].as_py() == bucket[0]):
            held.append(batch)
            continue
        yield from work(pa.Table.from_batches([*held, batch.slice(0, cut)]))
        held = [batch.slice(cut)]
    if held:
        yield from work(pa.Table.from_batches(held))


def similar_groups(docs: DataFrame, id_col="doc_id", text_col="text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of documents whose word shingles are similar (Jaccard), for ids that are not alone.

    SimHash bits at this similarity differ too often for blocks of them to deal documents out, so each
    document is dealt by KEYS minimum shingle hashes (a similar pair shares one with chance 1 - 0.2 ** 6),
    and the Gray-order index searches each bucket with a wide radius. Documents with equal shingle sets are
    compared once.

    The bits only find candidates. Components of candidates meet with their shingles, and documents link where
    the sets (of 64-bit hashes) have the similarity by count. Buckets and components of more than NEAR_BUCKET
    documents, and components of more than 2 * MEMBERS shingles, are cut into slices, and each two slices are
    searched together.

    Texts without words are alike. Rows with a null id are not looked at.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .arrow import pieces

        for batch in batches:
            for piece in pieces(batch, "text"):
                sets = [shingle_hashes(t, words) for t in piece.column("text").to_pylist()]
                wide, keys = wide_fingerprints(sets)
                ends = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * KEYS)
                columns = [
                    piece.column("id"), pa.array([w.tobytes() for w in wide], pa.binary()),
                    pa.ListArray.from_arrays(ends, pa.array(keys.ravel().view(np.int64))),
                    pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in sets], pa.binary()), pa.array([len(h) for h in sets], pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "wide", "keys", "digest", "size"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .arrow import pieces

        for batch in batches:
            for piece in pieces(batch, "text"):
                sets = [shingle_hashes(t, words) for t in piece.column("text").to_pylist()]
                ends = pa.array(np.concatenate(([0], np.cumsum([len(h) for h in sets]))), pa.int32())
                columns = [
                    piece.column("id"), piece.column("component"), piece.column("slices"),
                    pa.array([w.tobytes() for w in wide_fingerprints(sets)[0]], pa.binary()),
                    pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64))),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "component", "slices", "wide", "shingles"])

    def links(work: DataFrame) -> DataFrame:
        work = work.repartition("bucket").sortWithinPartitions("bucket")
        return work.mapInArrow(lambda it: similar_links(it, similarity), "a bigint, b bigint")

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL")
    signed = written(rows.mapInArrow(sign, "id bigint, wide binary, keys array<bigint>, digest binary, size int"))
    reps = signed.groupBy("digest", "wide", "keys").agg(F.min("id").alias("rep"), F.max("size").alias("size"))
    dealt = reps.select(F.col("rep").alias("id"), "wide", "keys", F.posexplode("keys").alias("tab", "key"))
    dealt = dealt.withColumn("bucket", F.xxhash64("tab", "key"))
    buckets = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    slices = F.when(F.col("n") > NEAR_BUCKET, F.ceil(F.col("n") / max(1, NEAR_BUCKET // 2))).otherwise(1)
    work = dealt.join(buckets.select("bucket", slices.alias("slices")), "bucket").select(cells("bucket").alias("bucket"), "id", "wide")
    near = components(links(work)).withColumnRenamed("node", "id")
    sizes = reps.groupBy(F.col("rep").alias("id")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    of = near.join(sizes, "id").groupBy("component").agg(
        F.ceil(F.greatest(F.sum("n") / max(1, NEAR_BUCKET // 2), F.sum("size") / MEMBERS)).alias("slices")
    )
    of = of.withColumn("slices", F.when(F.col("slices") > 2, F.col("slices")).otherwise(1))
    met = rows.join(near.join(of, "component"), "id").select("id", "text", "component", "slices")
    sets = met.mapInArrow(spread, "id bigint, component bigint, slices bigint, wide binary, shingles array<bigint>")
    similar = links(sets.select(cells("component").alias("bucket"), "id", "wide", "shingles"))
    copies = signed.join(reps.drop("size"), ["digest", "wide", "keys"]).select(F.col("id").alias("a"), F.col("rep").alias("b")).filter("a <> b")
    found = components(similar.unionByName(copies))
    return found.select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))


def cells(key: str, member: str = "id") -> Column:
    """A row for each cell of two slices that a member of group `key` with `slices` belongs to: every pair meets in one at least."""
    own = F.pmod(F.xxhash64(member), F.col("slices"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1), lambda j: (j != own) | (F.col("slices") == 1))
    return F.explode(F.transform(others, lambda j: F.xxhash64(key, F.least(own, j), F.greatest(own, j))))


def near_dedup(docs: DataFrame, id_col="doc_id", text_col="text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of similar texts, that with its smallest id; same columns.

    Only ids that go are joined to the documents, and rows with a null id stay. Repeated rows of one id all
    stay or go; of different texts under one id each counts. Null and empty texts are alike, so one of them stays.
    An empty table gives no rows. Other columns may have any names. Ids are numbers.
    """
    gone = similar_groups(docs, id_col, text_col, words, similarity).filter("doc_id <> component_id").select("doc_id")
    rows, name = masked(docs)
    return rows.join(gone, rows[name[id_col]] == gone["doc_id"], "left_anti").select(*unmasked(docs))

"""Embedding near-dedup: random-hyperplane sign hashing, exact cosine verification, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import ranges, runs
from .common import written
from .components import components

#: Signs in a key and tables. A pair at cosine 0.95 shares a key in some table with chance 0.9985, at 0.97 0.99997.
BITS, TABLES = 14, 26
#: Vectors of a bucket compared in one piece; larger buckets are cut into slices and dealt out by pairs of slices.
SLICE = 4096
#: Vectors of one block of a comparison (a block product has BLOCK * BLOCK doubles).
BLOCK = 1024
#: Pairs of signatures compared at once.
PAIRS = 1 << 17
#: Standard deviations of room in differing signs before a pair is ruled out; a pair at cosine 0.95 is lost at 3e-11.
ROOM = 7.0


def planes(dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, BITS * TABLES))


def sign_keys(x: np.ndarray, seed: int) -> np.ndarray:
    """(n, TABLES) keys of BITS signs each."""
    signs = (x @ planes(x.shape[1], seed) >= 0).reshape(len(x), TABLES, BITS)
    return (signs * (1 << np.arange(BITS))).sum(axis=2).astype(np.uint16)


def signatures(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """(rep, weight, values) to (rep, weight, dim, unit: bytes of the unit vector, keys: bytes)."""
    for batch in batches:
        rows = batch.column("values").to_pylist()
        dims = np.array([len(r) for r in rows])
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            x = np.array([rows[i] for i in at], dtype=np.float64)
            x /= np.abs(x).max(axis=1, keepdims=True)
            x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
            keys = sign_keys(x, seed)
            part = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("rep"), part.column("weight"), pa.array(np.full(len(at), dim, dtype=np.int32)),
                    pa.array([r.tobytes() for r in x], pa.binary()), pa.array([k.tobytes() for k in keys], pa.binary()),
                    pa.array(keys.astype(np.int32).tolist(), pa.list_(pa.int32())),
                ],
                ["rep", "weight", "dim", "unit", "sig", "keys"],
            )


def most_differing(threshold: float) -> int:
    """Signs in which two vectors at the threshold differ at most, but for ROOM: each differs with chance angle / pi."""
    signs, chance = BITS * TABLES, math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    return math.ceil(signs * chance + ROOM * math.sqrt(signs * chance * (1 - chance)) + 1)


def whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by cell as tables that hold all rows of their cells."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        cells = batch.column("cell").to_numpy()
        if not len(cells):
            continue
        cut = int(np.searchsorted(cells, cells[-1]))
        if cut == 0 and (not held or held[0].column("cell")[0].as_py() == cells[0]):
            held.append(batch)  # one cell so far; it has 2 * SLICE vectors at most
            continue
        yield pa.Table.from_batches([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def bucket_company(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (cell, tab, side, rep, sig) sorted by cell to those that have company: another vector of the cell, on the
    other side if it has sides, that differs in most_differing() signs at most over all tables and shares no earlier key."""
    most = most_differing(threshold)
    for t in whole_cells(batches):
        cell, tab, side = (t.column(c).to_numpy() for c in ("cell", "tab", "side"))
        n = len(cell)
        keys = np.frombuffer(b"".join(t.column("sig").to_pylist()), dtype=np.uint16).reshape(n, TABLES)
        words = np.zeros((n, -(-TABLES // 4) * 4), dtype=np.uint16)
        words[:, :TABLES] = keys
        words = words.view(np.uint64)
        starts = runs(cell)
        after = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n))) - np.arange(n) - 1
        total, kept, row = np.cumsum(after), np.zeros(n, dtype=bool), 0
        while row < n:
            # At least one row and its partners at a time: 2 * SLICE pairs at most beyond PAIRS.
            end = max(row + 1, int(np.searchsorted(total, (total[row - 1] if row else 0) + PAIRS, side="right")))
            some = np.arange(row, end)
            a, b = np.repeat(some, after[row:end]), ranges(some + 1, after[row:end])
            row = end
            ok = (side[a] == 0) | (side[a] != side[b])
            a, b = a[ok], b[ok]
            apart = np.zeros(len(a), dtype=np.uint16)
            for w in range(words.shape[1]):
                apart += np.bitwise_count(words[a, w] ^ words[b, w])
            near = apart <= most
            a, b = a[near], b[near]
            equal = keys[a] == keys[b]
            first = np.argmax(equal, axis=1) == tab[a]  # they share this table's key, so some key is equal
            kept[a[first]] = kept[b[first]] = True
        at = np.flatnonzero(kept)
        if len(at):
            yield from t.select(["rep", "cell", "tab", "side"]).take(pa.array(at)).combine_chunks().to_batches()


def bucket_matches(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell (a bucket, or a pair of slices of one) to (a, b, links).

    For each vector a of a cell: links, the copies behind the vectors that it is verified to match, and b, a
    vector to whose component it belongs. A pair that shares several keys counts in its first table only.
    """
    from .simhash import forest

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        cell, table, side = (t.column(c).to_numpy() for c in ("cell", "tab", "side"))
        rep, weight = (t.column(c).to_numpy() for c in ("rep", "weight"))
        units, sigs = t.column("unit").to_pylist(), t.column("sig").to_pylist()
        starts = runs(cell)
        out_a, out_b, out_n = [], [], []
        for s, n in zip(starts.tolist(), np.diff(np.append(starts, len(cell))).tolist()):
            if n < 2:
                continue
            x = np.frombuffer(b"".join(units[s : s + n]), dtype=np.float64).reshape(n, -1)
            k = np.frombuffer(b"".join(sigs[s : s + n]), dtype=np.uint16).reshape(n, TABLES)
            where, first_table, ids, w = side[s : s + n], table[s], rep[s : s + n], weight[s : s + n]
            links, pairs = np.zeros(n, dtype=np.int64), []
            for i in range(0, n, BLOCK):
                for j in range(i, n, BLOCK):
                    a, b = np.nonzero(x[i : i + BLOCK] @ x[j : j + BLOCK].T >= threshold)
                    a, b = a + i, b + j
                    # where: 0 in a whole bucket or a slice with itself, 1 and 2 in a pair of different slices.
                    ok = (a < b) & ((where[a] == 0) | (where[a] != where[b]))
                    a, b = a[ok], b[ok]
                    if first_table:
                        ok = ~(k[a, :first_table] == k[b, :first_table]).any(axis=1)
                        a, b = a[ok], b[ok]
                    if len(a):
                        np.add.at(links, a, w[b])
                        np.add.at(links, b, w[a])
                        pairs.append((a, b))
            if pairs:
                root, hit = forest(n, pairs), np.flatnonzero(links)
                out_a.append(ids[hit])
                out_b.append(ids[root[hit]])
                out_n.append(links[hit])
        if out_a:
            arrays = [pa.array(np.concatenate(x)) for x in (out_a, out_b, out_n)]
            yield pa.RecordBatch.from_arrays(arrays, ["a", "b", "links"])

    for t in whole_cells(batches):
        yield from work(t)


def near_vectors(
    vectors: DataFrame, id_col="vec_id", vector_col="embedding", threshold: float = 0.95, seed: int = 42
) -> DataFrame:
    """One row for each input row: vec_id, n_links, component_id, kept.

    Vectors of one dimension link where their cosine in double precision reaches the threshold. Equal vectors
    are grouped first and compared as one row with a weight, so copies make no pairs. Each distinct vector
    gets TABLES keys; ids and signs alone (52 bytes) go to the buckets of the keys, where vectors without a
    neighbour within most_differing(threshold) signs drop out, and pairs that met in an earlier table with them.
    Vectors travel only to buckets where they have company left, and are verified exactly in blocks there. A bucket of
    more than SLICE vectors is cut into slices by a hash and each pair of slices is compared in its own cell.
    Only counts and links to one member of each component leave a bucket.

    Null, empty and zero vectors and those with null or non-finite components have no links and are kept.
    component_id is the smallest vec_id reachable; rows that repeat an id are told apart by their vectors. A
    null id links like any other and names a component only where nothing else is in it. An empty table gives no
    rows; other columns, whatever their names, don't matter. A bucket of many distinct vectors that are all close is
    compared pair by pair, spread over the cells of its slices: that work is quadratic by nature.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("values"))
    bad = F.exists("values", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
    zero = ~F.exists("values", lambda x: x != 0)
    sound = F.coalesce(~bad & ~zero, F.lit(False))
    # -0.0 and 0.0 are one value to a hash of these.
    v = v.withColumn("values", F.when(sound, F.transform("values", lambda x: x + 0.0)))
    v = v.withColumn("same", F.when(F.col("values").isNotNull(), F.sha2(F.to_json(F.struct("values")).cast("binary"), 256)))
    groups = written(
        v.filter("same IS NOT NULL")
        .groupBy("same")
        .agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("first"), F.any_value("values").alias("values"))
        .withColumn("rep", F.xxhash64("same"))
    )
    signed = written(
        groups.select("rep", "weight", "values").mapInArrow(
            lambda it: signatures(it, seed), "rep bigint, weight bigint, dim int, unit binary, sig binary, keys array<int>"
        )
    )
    dealt = signed.select("rep", "sig", "dim", F.posexplode("keys").alias("tab", "key"))
    sizes = dealt.groupBy("dim", "tab", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    dealt = dealt.join(sizes, ["dim", "tab", "key"])
    slices = F.ceil(F.col("n") / SLICE).cast("int")
    own = F.pmod(F.xxhash64("rep", "tab"), slices).cast("int")
    # Slice s meets every slice t: cell (min, max), where it stands on side 1 or 2 (0 if s = t).
    cells = F.transform(
        F.sequence(F.lit(0), slices - 1),
        lambda t: F.struct(
            F.xxhash64("dim", "tab", "key", F.least(t, own), F.greatest(t, own)).alias("cell"),
            F.when(t == own, F.lit(0)).when(own < t, F.lit(1)).otherwise(F.lit(2)).alias("side"),
        ),
    )
    dealt = dealt.select("rep", "sig", "tab", F.explode(cells).alias("c")).select("rep", "sig", "tab", "c.cell", "c.side")
    dealt = dealt.repartition("cell").sortWithinPartitions("cell", "rep")
    company = dealt.mapInArrow(lambda it: bucket_company(it, threshold), "rep bigint, cell bigint, tab int, side int")
    work = company.join(signed.select("rep", "weight", "unit", "sig"), "rep").repartition("cell").sortWithinPartitions("cell", "tab", "rep")
    found = written(work.mapInArrow(lambda it: bucket_matches(it, threshold), "a bigint, b bigint, links bigint"))
    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    linked = components(found.select("a", "b")).withColumnRenamed("node", "rep")
    g = groups.select("same", "weight", "first", "rep").join(linked, "rep", "left").join(links, "rep", "left")
    g = g.withColumn("component", F.coalesce("component", "rep"))
    smallest = g.groupBy("component").agg(F.min("first").alias("component_id"))
    g = g.join(smallest, "component").select(
        "same", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")
    )
    component = F.when(F.col("same").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return v.select("vec_id", "same").join(g, "same", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("vec_id")).alias("kept"),
    )

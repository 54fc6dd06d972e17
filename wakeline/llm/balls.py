"""Clustering by ball k-means: only centroids near enough to a vector's own ball are compared with it."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written


@dataclass(frozen=True)
class Balls:
    """Centroids with, for each ball, its neighbours from the nearest on and their squared distances to its centre.

    A centroid j is a neighbour of ball i if it is within twice the ball's radius of i's centre: for a vector x of the
    ball, |c_i - c_j| > 2 |x - c_i| gives |x - c_j| > |x - c_i|, so no other centroid can win. All distances are
    squared integers, so nothing here is rounded.
    """

    centres: np.ndarray
    neighbours: list[np.ndarray]
    gaps: list[np.ndarray]

    @classmethod
    def of(cls, centres: np.ndarray, radii: list[int | None]) -> Balls:
        """radii: an upper bound of each ball's radius, None if there is none yet."""
        neighbours, gaps = [], []
        for i, c in enumerate(centres):
            gap = ((centres - c) ** 2).sum(axis=1)
            order = [j for j in np.argsort(gap, kind="stable").tolist() if j != i and (radii[i] is None or int(gap[j]) <= 4 * radii[i] ** 2)]
            neighbours.append(np.array(order, dtype=np.int64))
            gaps.append(gap[neighbours[-1]])
        return cls(centres, neighbours, gaps)

    def nearest(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, squared distance) of each row of x, whose ball is own; of equally near centroids the smaller number.

        Rows nearer to their centre than half the way to the first neighbour are the stable core and are compared with
        no other; a row of the r-th annulus is compared with the first r neighbours.
        """
        best, distance = own.copy(), np.empty(len(x), dtype=np.int64)
        for i in np.unique(own):
            rows = np.flatnonzero(own == i)
            d = ((x[rows] - self.centres[i]) ** 2).sum(axis=1)
            annulus = np.searchsorted(self.gaps[i], 4 * d, side="right")
            number, least = np.full(len(rows), i, dtype=np.int64), d.copy()
            for rank, j in enumerate(self.neighbours[i].tolist()):
                at = np.flatnonzero(annulus > rank)
                if not len(at):
                    break
                other = ((x[rows[at]] - self.centres[j]) ** 2).sum(axis=1)
                wins = (other < least[at]) | ((other == least[at]) & (j < number[at]))
                number[at[wins]], least[at[wins]] = j, other[wins]
            best[rows], distance[rows] = number, least
        return best, distance


def largest_component(dim: int) -> int:
    """The largest component whose squared distances, four times over, stay within 64 bits."""
    return min(math.isqrt((1 << 61) // max(1, dim)) // 2, (1 << 31) - 1)


def whole_components(vector: Column, dim: int, scale: int) -> Column:
    """The components times scale, floored, as an array<int>; null for vectors that are not kept."""
    usable = F.coalesce((F.size(vector) == dim) & F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False))), F.lit(False))
    large = F.lit(largest_component(dim))
    scaled = lambda x: F.floor(x.cast("double") * F.lit(float(scale)))
    whole = F.transform(
        vector,
        lambda x: F.when(F.abs(x.cast("double") * F.lit(float(scale))) <= large, scaled(x)).otherwise(F.raise_error(F.lit("a component is too large for exact distances"))).cast("int"),
    )
    return F.when(usable, whole)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _assigned(rows: DataFrame, balls: Balls, dim: int) -> DataFrame:
    """rows(_id, _x, _own) with _own and _d by the balls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, d = balls.nearest(_matrix(batch.column("_x"), dim), batch.column("_own").to_numpy(zero_copy_only=False).astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_x"), pa.array(own), pa.array(d)], ["_id", "_x", "_own", "_d"])

    return rows.mapInArrow(run, "_id bigint, _x array<int>, _own bigint, _d bigint")


def _sums(rows: DataFrame, dim: int) -> dict[int, tuple[int, int, int, list[int]]]:
    """For each ball that has vectors: their number, largest and summed squared distance, and componentwise sums.

    One row for each task, ball and component is shuffled, and one for each ball and component comes to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, far, spread, total = {}, {}, {}, {}
        for batch in batches:
            x, own, d = _matrix(batch.column("_x"), dim), *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("_own", "_d"))
            for i in np.unique(own).tolist():
                at = own == i
                n[i] = n.get(i, 0) + int(at.sum())
                far[i] = max(far.get(i, 0), int(d[at].max()))
                spread[i] = spread.get(i, 0) + sum(d[at].tolist())
                total[i] = total.get(i, 0) + x[at].sum(axis=0)
        keys = list(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array([n[i] for i in keys], pa.int64()), pa.array([far[i] for i in keys], pa.int64()),
             pa.array([str(spread[i]) for i in keys], pa.string()), pa.array([total[i].tolist() for i in keys], pa.list_(pa.int64()))],
            ["ball", "n", "far", "spread", "total"],
        )

    parts = rows.mapInArrow(run, "ball bigint, n bigint, far bigint, spread string, total array<bigint>")
    exact = lambda c: F.sum(c.cast("decimal(38,0)"))
    each = parts.select("ball", "n", "far", "spread", F.posexplode("total").alias("p", "x"))
    found = each.groupBy("ball", "p").agg(F.sum("n"), F.max("far"), exact(F.col("spread")), exact(F.col("x"))).orderBy("ball", "p").collect()
    out: dict[int, tuple[int, int, int, list[int]]] = {}
    for ball, _, n, far, spread, x in found:
        out.setdefault(ball, (n, far, int(spread), []))[3].append(int(x))
    return out


def first_centres(rows: DataFrame, k: int, seed: int, dim: int) -> np.ndarray:
    """The k rows whose sha256 of "seed:id" is smallest; rows without an id come last, repeated ids by their components."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string")), 256)
    chosen = rows.orderBy(order.asc_nulls_last(), "_x").limit(k).collect()
    return np.array([r["_x"] for r in chosen], dtype=np.int64).reshape(-1, dim)


def ball_kmeans(
    vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row for each kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly dim components, none null or non-finite; components become floor(scale * x). Each round
    assigns every vector to the nearest centroid and replaces each centroid that has vectors by their componentwise
    floor(sum / count); at the end vectors are assigned once more. When no centroid moves, later rounds would change
    nothing and are left out. A ball's radius is bounded by its farthest vector at assignment and by how far its
    centroid moved since; see Balls for what that saves.

    Each round reads the vectors with their balls once, and writes them to the shared folder; rows are never shuffled, only
    sums of k balls are. A hot ball is no hot task. Distances are exact: components beyond largest_component() are an
    error. Null, short, long and broken vectors give no row, repeated rows are rows of their own, fewer vectors than
    k give as many centroids, an empty table gives no rows. Ids are numbers; a null id stays null and is
    never a first centroid while k others are left. Other columns, whatever their names, don't matter.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), whole_components(F.col(vector_col), dim, scale).alias("_x")).filter(F.col("_x").isNotNull())
    state = written(rows.select("_id", "_x", F.lit(0).cast("long").alias("_own")))
    centres = first_centres(state, k, seed, dim)
    if not len(centres):
        centres = np.zeros((1, dim), dtype=np.int64)
    radii: list[int | None] = [None] * len(centres)
    sums: dict[int, tuple[int, int, int, list[int]]] = {}
    for step in range(rounds + 1):
        before, state = state, written(_assigned(state.select("_id", "_x", "_own"), Balls.of(centres, radii), dim))
        discard(before)
        sums = _sums(state, dim)
        if step == rounds:
            break
        moved = centres.copy()
        for i, (n, _, _, total) in sums.items():
            moved[i] = [s // n for s in total]
        shift = ((moved - centres) ** 2).sum(axis=1).tolist()
        if not any(shift):
            break
        radii = [math.isqrt(sums[i][1]) + math.isqrt(s) + 2 if i in sums else 0 for i, s in enumerate(shift)]
        centres = moved
    inertia = sum(s[2] for s in sums.values())
    text = F.concat_ws(",", *[F.col("c")[p].cast("string") for p in range(dim)])
    facts = vectors.sparkSession.createDataFrame(
        [(i, s[2], inertia, centres[i].tolist()) for i, s in sums.items()], "_own long, cluster_inertia long, inertia long, c array<long>"
    ).select("_own", "cluster_inertia", "inertia", F.sha2(text, 256).alias("centroid_sha256"))
    return state.join(F.broadcast(facts), "_own").select(
        F.col("_id").alias("vec_id"), F.col("_own").cast("int").alias("cluster"), F.col("_d").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256"
    )

"""Which boxes meet: a packed index for tables that fit in a task, and a join over grid squares for those that don't."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Children of a node, and queries that go down the index together.
FAN, QUERIES = 16, 2048


def hilbert(x: np.ndarray, y: np.ndarray, bits: int = 16) -> np.ndarray:
    """The place of each point (integers of so many bits) along the Hilbert curve."""
    x, y, out = x.astype(np.int64), y.astype(np.int64), np.zeros(len(x), dtype=np.int64)
    for bit in reversed(range(bits)):
        right, up = (x >> bit) & 1, (y >> bit) & 1
        out = (out << 2) | ((3 * right) ^ up)
        turn = (up == 0) & (right == 1)
        low = (1 << bit) - 1
        x, y = np.where(turn, low - (x & low), x & low), np.where(turn, low - (y & low), y & low)
        x, y = np.where(up == 0, y, x), np.where(up == 0, x, y)
    return out


class PackedBoxes:
    """A tree of boxes (min x, min y, max x, max y) in Hilbert order of their middles, level by level in flat arrays.

    Finding the pairs of many queries goes down all levels with arrays of (query, node), so it takes time in
    proportion to the nodes hit, not to queries times boxes.
    """

    def __init__(self, boxes: np.ndarray):
        boxes = np.asarray(boxes, dtype=float).reshape(-1, 4)
        if len(boxes):
            middle = (boxes[:, :2] + boxes[:, 2:]) / 2
            room = np.maximum(np.ptp(middle, axis=0), 1e-300)
            places = ((middle - middle.min(axis=0)) / room * 65535).astype(np.int64)
            self.order = np.argsort(hilbert(places[:, 0], places[:, 1]), kind="stable")
        else:
            self.order = np.zeros(0, dtype=np.int64)
        self.levels = [boxes[self.order]]
        while len(self.levels[-1]) > FAN:
            below = self.levels[-1]
            starts = np.arange(0, len(below), FAN)
            self.levels.append(np.hstack([np.minimum.reduceat(below[:, :2], starts), np.maximum.reduceat(below[:, 2:], starts)]))

    def pairs(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, box) for each box that meets the closed query box from low to high, in order of both."""
        found = [self._down(low, high, at) for at in np.array_split(np.arange(len(low)), -(-len(low) // QUERIES) or 1)]
        return np.concatenate([q for q, _ in found]), np.concatenate([b for _, b in found])

    def _down(self, low: np.ndarray, high: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top = len(self.levels[-1])
        who, node = np.repeat(queries, top), np.tile(np.arange(top), len(queries))
        for depth in range(len(self.levels) - 1, -1, -1):
            box = self.levels[depth][node]
            least, most = low[who], high[who]
            meets = (box[:, 0] <= most[:, 0]) & (box[:, 1] <= most[:, 1]) & (box[:, 2] >= least[:, 0]) & (box[:, 3] >= least[:, 1])
            who, node = who[meets], node[meets]
            if depth:
                who, node = np.repeat(who, FAN), (node[:, None] * FAN + np.arange(FAN)).ravel()
                real = node < len(self.levels[depth - 1])
                who, node = who[real], node[real]
        box = self.order[node]
        order = np.lexsort((box, who))
        return who[order], box[order]


def _level(finest: int) -> Column:
    """The power of two that is the side of the squares a box is dealt to: as large as the box at least."""
    extent = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return F.greatest(F.lit(finest), F.when(extent > 0, F.ceil(F.log2(extent))).otherwise(F.lit(finest))).cast("int")


def _deal(role: str, level: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), level.alias("level"))


def _dealt(boxes: DataFrame, prefix: str, deals: Column) -> DataFrame:
    """A row for each square that a box touches, at the level of each of its deals: at most four each."""
    each = boxes.withColumn("deal", F.explode(deals)).withColumn("side", F.pow(F.lit(2.0), "deal.level"))
    squares = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / F.col("side")), F.floor(F.col(b) / F.col("side"))))
    each = each.withColumn("gx", squares("x0", "x1")).withColumn("gy", squares("y0", "y1"))
    return each.select("deal", "side", "gx", "gy", *[F.col(c).alias(f"{prefix}{c}") for c in ("id", "x0", "y0", "x1", "y1")])


def meeting(left: DataFrame, right: DataFrame, finest: int = 6) -> DataFrame:
    """(left_id, right_id) once for each two boxes that meet, edges and corners included.

    Both tables are (id, x0, y0, x1, y1); boxes with null or non-finite bounds meet none. A box's level is the power of two
    that is as large as it; two boxes are compared in the squares of the larger level of both, of which each touches four at most.
    The smaller box is dealt to the squares of each level above its own that the other table has; there are as many levels as
    powers of two between the smallest and the largest box. A pair that shares several squares counts in the one that
    holds the lower left corner of what both share. All is an equi join, so neither side need be small and crowded squares split
    as skewed keys do; repeated rows give repeated pairs.
    """
    usable = lambda d: d.filter(" AND ".join(f"abs({c}) < double('infinity')" for c in ("x0", "y0", "x1", "y1")) + " AND x0 <= x1 AND y0 <= y1")
    left, right = (usable(d.select("id", "x0", "y0", "x1", "y1")).withColumn("own", _level(finest)) for d in (left, right))
    has = lambda d: F.array(*[F.lit(r[0]) for r in d.select("own").distinct().collect()]).cast("array<int>")
    left_levels, right_levels = has(left), has(right)
    above = lambda role, levels, keep: F.transform(F.filter(levels, keep), lambda x: _deal(role, x))
    own = F.col("own")
    l_rows = _dealt(left, "l_", F.concat(F.array(_deal("own", own)), above("smaller", right_levels, lambda x: x > own)))
    r_rows = _dealt(right, "r_", F.concat(F.array(_deal("smaller", own)), above("own", left_levels, lambda x: x >= own)))
    met = l_rows.join(r_rows.drop("side"), ["deal", "gx", "gy"])
    overlap = (F.col("l_x0") <= F.col("r_x1")) & (F.col("r_x0") <= F.col("l_x1")) & (F.col("l_y0") <= F.col("r_y1")) & (F.col("r_y0") <= F.col("l_y1"))
    counted = lambda g, a, b: F.floor(F.greatest(a, b) / F.col("side")) == F.col(g)
    return met.filter(overlap & counted("gx", "l_x0", "r_x0") & counted("gy", "l_y0", "r_y0")).select(F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id"))

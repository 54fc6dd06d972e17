"""A tile of cells with area, land and support polygons, and exact clipping of straight routes against it.

Routes are segments in projected metres, P(t) = A + t (B - A). The tile is configuration of checked size
(at most max_cells polygons); it goes to the tasks with the function. Clipping runs in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.cellids import fault_of
from ..functions.identity import plain_fingerprint
from ..functions.projection import LocalProjection
from .boxes import PackedBoxes

Ring = list[tuple[float, float]]


#: Routes clipped or screened at once.
ROUTES = 2048
#: Metres up to which two places differ by rounding alone.
ROUNDING_M = 1e-6


@dataclass(frozen=True)
class TileConfig:
    projection: LocalProjection
    resolution: int
    numerical_tolerance_m: float = 0.001
    material_land_crossing_m: float = 5.0
    shoreline_uncertainty_m: float = 2.0
    max_cells: int = 5000
    max_candidates: int = 500
    max_geometry_vertices: int = 20_000
    #: Whether ids must be published hexagonal ids of the resolution; else they are any lower-case text.
    published_ids: bool = False


def rings_of(document: dict, projection: LocalProjection, most: int, allow_empty: bool = False) -> list[Ring]:
    """Projected rings (shells and holes alike) of a GeoJSON Polygon or MultiPolygon."""
    kind = document.get("type")
    if kind not in ("Polygon", "MultiPolygon"):
        raise ValueError("a Polygon or MultiPolygon is required")
    polygons = [document["coordinates"]] if kind == "Polygon" else document["coordinates"]
    if any(polygon and not polygon[0] and any(polygon) for polygon in polygons):
        raise ValueError("a polygon has holes and no shell")
    rings = [ring for polygon in polygons for ring in polygon if ring]
    if sum(map(len, rings)) > most:
        raise ValueError("a geometry has too many vertices")
    if not rings and not allow_empty:
        raise ValueError("a geometry is empty")
    if any(len(r) < 4 or tuple(r[0][:2]) != tuple(r[-1][:2]) for r in rings):
        raise ValueError("a ring isn't closed")
    projected = [[projection.forward_point(p[0], p[1]) for p in ring] for ring in rings]
    if crossing(projected):
        raise ValueError("the rings of a geometry cross or overlap")
    sizes = [sum(map(bool, polygon)) for polygon in polygons]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    if misplaced(projected, owner):
        raise ValueError("a hole isn't in its shell, or a polygon lies in another")
    return projected


def ring_numbers(rings: list[Ring]) -> np.ndarray:
    """The ring of each edge of Edges(rings)."""
    return np.repeat(np.arange(len(rings)), [sum(a != b for a, b in zip(r, r[1:])) for r in rings])


def misplaced(rings: list[Ring], owner: np.ndarray) -> bool:
    """Whether rings that don't cross are nested wrongly; owner is the polygon of each, whose first ring is its shell.

    Rings that don't cross lie inside one another as a whole, so one point of each tells: a vertex or an edge's middle that is
    on no other ring. A hole lies in its own shell and in no other ring of its polygon, a shell in none; no ring lies within
    another polygon, that is, in an odd number of its rings.
    """
    if len(rings) < 2:
        return False
    shape, ring, n = Edges(rings), ring_numbers(rings), len(rings)
    points, of = np.concatenate([shape.a, (shape.a + shape.b) / 2]), np.concatenate([ring, ring])
    test, which = shape.around(points, points, 1e-6)
    foreign = ring[which] != of[test]
    test, which = test[foreign], which[foreign]
    t = np.clip(((points[test] - shape.a[which]) * shape.d[which]).sum(axis=1) / shape.square[which], 0, 1)
    apart = np.hypot(*(shape.a[which] + t[:, None] * shape.d[which] - points[test]).T)
    free = np.ones(len(points), dtype=bool)
    free[test[apart <= 1e-6]] = False
    known, first = np.unique(of[free], return_index=True)
    if len(known) < n:
        return True
    p = points[free][first]
    test, which = shape.index.pairs(p, np.stack([np.full(n, np.inf), p[:, 1]], axis=1))
    a, b, q = shape.a[which], shape.b[which], p[test]
    across = (a[:, 1] > q[:, 1]) != (b[:, 1] > q[:, 1])
    with np.errstate(divide="ignore", invalid="ignore"):
        at = a[:, 0] + (q[:, 1] - a[:, 1]) * shape.d[which, 0] / shape.d[which, 1]
    hit = across & (at > q[:, 0]) & (ring[which] != test)
    key, count = np.unique(test[hit] * n + ring[which[hit]], return_counts=True)
    inner, outer = np.divmod(key[count % 2 == 1], n)
    shell = np.concatenate(([True], owner[1:] != owner[:-1]))
    own = owner[inner] == owner[outer]
    within_own = np.bincount(inner[own], minlength=n)
    in_shell = np.bincount(inner[own & shell[outer]], minlength=n)
    pair, rings_of_other = np.unique(inner[~own] * n + owner[outer[~own]], return_counts=True)
    return bool((within_own != ~shell).any() or (in_shell != ~shell).any() or (rings_of_other % 2 == 1).any())


def crossing(rings: list[Ring]) -> bool:
    """Whether two edges of the rings cross or lie on each other, or a ring meets itself; rings may touch in points."""
    shape = Edges(rings)
    ring = ring_numbers(rings)
    if not len(ring):
        return bool(rings)
    if (np.bincount(ring, minlength=len(rings)) < 3).any():
        return True
    start = np.searchsorted(ring, ring)
    size = np.searchsorted(ring, ring, side="right") - start
    follows = start + (np.arange(len(ring)) - start + 1) % size
    low, high = np.minimum(shape.a, shape.b), np.maximum(shape.a, shape.b)
    order = np.argsort(low[:, 0], kind="stable")
    ends = np.searchsorted(low[order, 0], high[order, 0], side="right")
    for at in np.array_split(np.arange(len(order)), -(-len(order) // 64)):
        first = np.repeat(at, ends[at] - at - 1)
        i, j = order[first], order[span(at + 1, ends[at] - at - 1)]
        near = (low[i, 1] <= high[j, 1]) & (low[j, 1] <= high[i, 1])
        i, j = i[near], j[near]
        side = lambda o, d, p: d[:, 0] * (p - o)[:, 1] - d[:, 1] * (p - o)[:, 0]
        ia, ib = side(shape.a[i], shape.d[i], shape.a[j]), side(shape.a[i], shape.d[i], shape.b[j])
        ja, jb = side(shape.a[j], shape.d[j], shape.a[i]), side(shape.a[j], shape.d[j], shape.b[i])
        if ((ia * ib < 0) & (ja * jb < 0)).any():
            return True
        flat = (ia == 0) & (ib == 0)
        along = shape.d[i] / np.sqrt(shape.square[i])[:, None]
        to = [((x[j] - shape.a[i]) * along).sum(axis=1) for x in (shape.a, shape.b)]
        shared = np.minimum(np.sqrt(shape.square[i]), np.maximum(*to)) - np.maximum(0, np.minimum(*to))
        if (flat & (shared > 0)).any():
            return True
        touch = (ia * ib <= 0) & (ja * jb <= 0) & ~flat
        if (touch & (ring[i] == ring[j]) & (follows[i] != j) & (follows[j] != i)).any():
            return True
    return False


class Edges:
    """The edges of a set of rings."""

    def __init__(self, rings: Iterable[Ring]):
        pairs = [(a, b) for ring in rings for a, b in zip(ring, ring[1:]) if a != b]
        flat = np.array([(*a, *b) for a, b in pairs], dtype=float).reshape(-1, 4)
        self.a, self.b = flat[:, :2], flat[:, 2:]
        self.d = self.b - self.a
        self.square = (self.d**2).sum(axis=1)
        self.box = (*np.minimum(self.a, self.b).min(axis=0), *np.maximum(self.a, self.b).max(axis=0)) if len(flat) else None

    @cached_property
    def index(self) -> PackedBoxes:
        return PackedBoxes(np.hstack([np.minimum(self.a, self.b), np.maximum(self.a, self.b)]))

    def around(self, p: np.ndarray, q: np.ndarray, distance: float) -> tuple[np.ndarray, np.ndarray]:
        """(route, edge) whose boxes come within a distance, with some room for rounding."""
        room = distance + 1e-6
        return self.index.pairs(np.minimum(p, q) - room, np.maximum(p, q) + room)

    def inside(self, points: np.ndarray) -> np.ndarray:
        """Even-odd rule: edges that a ray to the right crosses."""
        ray = np.stack([np.full(len(points), np.inf), points[:, 1]], axis=1)
        return contains_many(points, *self.index.pairs(points, ray), self, len(points))[0]

    def away(self, points: np.ndarray, most: float) -> np.ndarray:
        """The distance to the next edge; infinite where it is more than most, about."""
        return contains_many(points, *self.around(points, points, most), self, len(points))[1]


def joined(shapes: list[Edges]) -> Edges:
    out = Edges([])
    out.a, out.b = np.concatenate([s.a for s in shapes]), np.concatenate([s.b for s in shapes])
    out.d = out.b - out.a
    out.square = (out.d**2).sum(axis=1)
    return out


def span(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All of start[i] .. start[i] + count[i] - 1, one after another."""
    total = int(count.sum())
    return np.arange(total) + np.repeat(start - (np.cumsum(count) - count), count)


def cuts_many(p: np.ndarray, d: np.ndarray, who: np.ndarray, edges: Edges, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(route, parameter) at which route who[i] meets edge which[i], with both ends of overlaps."""
    a, e, square = edges.a[which], edges.d[which], edges.square[which]
    d, to = d[who], edges.a[which] - p[who]
    length = (d * d).sum(axis=1)
    cross = d[:, 0] * e[:, 1] - d[:, 1] * e[:, 0]
    meets = np.abs(cross) > 1e-12 * np.sqrt(length * square)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (to[:, 0] * e[:, 1] - to[:, 1] * e[:, 0]) / cross
        s = (to[:, 0] * d[:, 1] - to[:, 1] * d[:, 0]) / cross
    ok = meets & (t >= 0) & (t <= 1) & (s >= 0) & (s <= 1)
    along = np.flatnonzero(~meets & (np.abs(d[:, 0] * to[:, 1] - d[:, 1] * to[:, 0]) <= 1e-9 * length))
    ends = np.stack([((x[along] - p[who[along]]) * d[along]).sum(axis=1) / length[along] for x in (a, edges.b[which])])
    lo, hi = np.maximum(0, ends.min(axis=0)), np.minimum(1, ends.max(axis=0))
    both = lo <= hi
    own = who[along][both]
    return np.concatenate([who[ok], own, own]), np.concatenate([t[ok], lo[both], hi[both]])


def contains_many(points: np.ndarray, test: np.ndarray, which: np.ndarray, edges: Edges, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(inside, distance) of n tests of a point against some edges: test[i] looks at edge which[i]."""
    if not len(test):
        return np.zeros(n, dtype=bool), np.full(n, np.inf)
    p, a, b, e = points[test], edges.a[which], edges.b[which], edges.d[which]
    across = (a[:, 1] > p[:, 1]) != (b[:, 1] > p[:, 1])
    with np.errstate(divide="ignore", invalid="ignore"):
        at = a[:, 0] + (p[:, 1] - a[:, 1]) * e[:, 0] / e[:, 1]
    crossings = np.bincount(test, weights=across & (at > p[:, 0]), minlength=n)
    t = np.clip(((p - a) * e).sum(axis=1) / edges.square[which], 0, 1)
    apart = np.full(n, np.inf)
    np.minimum.at(apart, test, np.hypot(*(a + t[:, None] * e - p).T))
    return crossings % 2 == 1, apart


def near_many(p: np.ndarray, d: np.ndarray, who: np.ndarray, edges: Edges, which: np.ndarray, distance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(route, from, to): where route who[i] is within a distance of edge which[i].

    A line cuts the capsule around an edge once: the interval spans those of the discs at both ends and of the strip between.
    """
    a, b, e, size = edges.a[which], edges.b[which], edges.d[which], np.sqrt(edges.square[which])
    p, d = p[who], d[who]
    length = (d * d).sum(axis=1)
    low, high = np.full(len(who), np.inf), np.full(len(who), -np.inf)
    with np.errstate(divide="ignore", invalid="ignore"):
        for centre in (a, b):
            f = p - centre
            half = (f * d).sum(axis=1)
            square = half * half - length * ((f * f).sum(axis=1) - distance**2)
            root = np.sqrt(square)
            low = np.where(square >= 0, np.minimum(low, (-half - root) / length), low)
            high = np.where(square >= 0, np.maximum(high, (-half + root) / length), high)
        first, last = np.full(len(who), -np.inf), np.full(len(who), np.inf)
        for n, lo, hi in ((np.stack([-e[:, 1], e[:, 0]], axis=1), -distance, distance), (e, 0.0, size)):
            start, speed = ((p - a) * n).sum(axis=1) / size, (d * n).sum(axis=1) / size
            still = np.abs(speed) < 1e-15
            to = np.sort(np.stack([(lo - start) / speed, (hi - start) / speed]), axis=0)
            held = (lo <= start) & (start <= hi)
            first = np.maximum(first, np.where(still, np.where(held, -np.inf, np.inf), to[0]))
            last = np.minimum(last, np.where(still, np.where(held, np.inf, -np.inf), to[1]))
    strip = first <= last
    low, high = np.where(strip, np.minimum(low, first), low), np.where(strip, np.maximum(high, last), high)
    low, high = np.maximum(low, 0.0), np.minimum(high, 1.0)
    ok = low <= high
    return who[ok], low[ok], high[ok]


def covered(who: np.ndarray, low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """The length of the union of each route's intervals. Ranks, not sums, keep routes apart, so nothing is rounded away."""
    order = np.lexsort((low, who))
    who, low, high = who[order], low[order], high[order]
    ascending = np.sort(high)
    rank = np.searchsorted(ascending, high)
    reach = np.maximum.accumulate(who * len(high) + rank) if len(who) else rank
    before = np.full(len(who), -np.inf)
    same = np.flatnonzero(who[1:] == who[:-1]) + 1
    before[same] = ascending[reach[same - 1] - who[same] * len(high)]
    return np.bincount(who, weights=np.maximum(0.0, high - np.maximum(low, before)), minlength=n)


def merged_cuts(who: np.ndarray, t: np.ndarray, length: np.ndarray, tolerance: float) -> np.ndarray:
    """Which cuts stay, of cuts in order of route and place: 0, 1, and of others each farther than the tolerance from the last one kept."""
    starts = np.concatenate(([True], who[1:] != who[:-1]))
    ends = np.concatenate((starts[1:], [True]))
    size = length[who]
    far = starts.copy()
    far[1:] |= (t[1:] - t[:-1]) * size[1:] > tolerance
    # Cuts close to each other make a group, kept by its first; only groups longer than the tolerance are gone through one by one.
    group = np.flatnonzero(far)
    last = np.append(group[1:], len(t)) - 1
    long = (t[last] - t[group]) * size[group] > tolerance
    for a, b in zip(group[long].tolist(), last[long].tolist()):
        kept = t[a]
        for i in range(a + 1, b + 1):
            if (t[i] - kept) * size[i] > tolerance:
                far[i], kept = True, t[i]
    return (far & (t < 1)) | ends


def ends_of(*columns: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, ok) of routes in four Arrow columns; ok where no coordinate is null or non-finite."""
    x = np.stack([c.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) for c in columns], axis=1)
    return x[:, :2], x[:, 2:], np.isfinite(x).all(axis=1)


class Tile:
    """The checked geometry of one local tile, in projected metres.

    cells: (id, ring) pairs with rings in longitude and latitude; ids are compared as text. The boundaries are
    an input because their tables aren't part of this library.
    """

    def __init__(self, config: TileConfig, aoi: dict, land: dict, support: dict, cells: list[tuple[str, Ring]]):
        ids = [c for c, _ in cells]
        if not ids or len(ids) > config.max_cells or len(set(ids)) != len(ids):
            raise ValueError(f"1 to {config.max_cells} distinct cells are required")
        if any(not c.strip() or c != c.lower() for c in ids):
            raise ValueError("cell ids must be lower-case text")
        if config.published_ids and (bad := {c: f for c in ids if (f := fault_of(c, config.resolution))}):
            raise ValueError(f"cell ids with faults: {bad}")
        self.config = config
        self.fingerprint = plain_fingerprint([repr(config), aoi, land, support, sorted([c, [list(p) for p in ring]] for c, ring in cells)])
        rings = lambda d, empty=False: rings_of(d, config.projection, config.max_geometry_vertices, empty)
        self.aoi, self.land, self.support = Edges(rings(aoi)), Edges(rings(land, True)), Edges(rings(support))
        self.cells = sorted(ids)
        by_id = dict(cells)
        self.shapes = [Edges([[config.projection.forward_point(*p) for p in by_id[c]]]) for c in self.cells]
        self.boxes = np.array([s.box for s in self.shapes])
        self.index = PackedBoxes(self.boxes)
        self.edge_count = np.array([len(s.a) for s in self.shapes])
        self.edge_start = np.cumsum(self.edge_count) - self.edge_count
        self.cell_edges = joined(self.shapes)

    def candidate_pairs(self, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(route, cell) for boxes that come within the tolerance of each other, by route and id."""
        e = self.config.numerical_tolerance_m
        route, cell = self.index.pairs(np.minimum(p, q) - e, np.maximum(p, q) + e)
        if len(route) and np.bincount(route).max() > self.config.max_candidates:
            raise ValueError("a route has too many candidate cells")
        return route, cell

    def parts_many(self, p: np.ndarray, q: np.ndarray, exact: bool = False) -> list[list[tuple[float, float, str | None]]]:
        """For each route P to Q: (from, to, cell) covering [0, 1]; cell is None outside the area.

        Pieces up to the tolerance join the one before, and a cell owns what lies within the tolerance of it, the smallest id first.
        exact: only what is nearer than ROUNDING_M counts as one place, so slivers between cells stay and belong to the cell they lie in.
        """
        sizes, lo, hi, owner = self._parts(p, q, exact)
        names = [*self.cells, None]
        rows = [(a, b, names[o]) for a, b, o in zip(lo.tolist(), hi.tolist(), owner.tolist())]
        ends = np.cumsum(sizes).tolist()
        return [rows[e - s : e] for s, e in zip(sizes.tolist(), ends)]

    def _parts(self, p: np.ndarray, q: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The number of parts of each route, and (from, to, number of the cell) of all parts; number len(cells) is outside.

        All routes at once: cuts of routes with the edges of their candidate cells and of the area, then one owner for each middle.
        """
        n, d, tolerance = len(p), q - p, self.config.numerical_tolerance_m
        if not n:
            return np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0), np.zeros(0, dtype=np.int64)
        length = np.hypot(*d.T)
        route, cell = self.candidate_pairs(p, q)
        edge = span(self.edge_start[cell], self.edge_count[cell])
        of = np.repeat(route, self.edge_count[cell])
        area_of, area_edge = self.aoi.around(p, q, 0.0)
        cut_of, cut = [np.arange(n), np.arange(n)], [np.zeros(n), np.ones(n)]
        for who, edges, which in ((of, self.cell_edges, edge), (area_of, self.aoi, area_edge)):
            moving = length[who] > 0
            w, t = cuts_many(p, d, who[moving], edges, which[moving])
            cut_of.append(w)
            cut.append(t)
        who, t = np.concatenate(cut_of), np.concatenate(cut)
        order = np.lexsort((t, who))
        who, t = who[order], t[order]
        kept = merged_cuts(who, t, length, min(ROUNDING_M, tolerance) if exact else tolerance)
        who, t = who[kept], t[kept]
        piece = np.flatnonzero(who[1:] == who[:-1])
        mine, lo, hi = who[piece], t[piece], t[piece + 1]
        middle = p[mine] + ((lo + hi) / 2)[:, None] * d[mine]
        m = len(middle)
        in_area = self.aoi.inside(middle) | (self.aoi.away(middle, 0.0) == 0)
        first, count = np.searchsorted(route, np.arange(n)), np.bincount(route, minlength=n)
        asking = np.flatnonzero(in_area)
        asked = cell[span(first[mine[asking]], count[mine[asking]])]
        asks = np.repeat(asking, count[mine[asking]])
        box, at = self.boxes[asked], middle[asks]
        x, y = at[:, 0], at[:, 1]
        near = (box[:, 0] <= x + tolerance) & (box[:, 1] <= y + tolerance) & (box[:, 2] >= x - tolerance) & (box[:, 3] >= y - tolerance)
        asks, asked = asks[near], asked[near]
        which = span(self.edge_start[asked], self.edge_count[asked])
        test = np.repeat(np.arange(len(asks)), self.edge_count[asked])
        inside, apart = contains_many(middle[asks], test, which, self.cell_edges, len(asks))
        owner = np.full(m, len(self.cells))
        for reach in (min(ROUNDING_M, tolerance), tolerance) if exact else (tolerance,):
            hit = (inside | (apart <= reach)) & (owner[asks] == len(self.cells))
            np.minimum.at(owner, asks[hit], asked[hit])
        if (owner[in_area] == len(self.cells)).any():
            raise ValueError("a point of the area lies in no cell")
        return np.bincount(mine, minlength=n), lo, hi, owner

    def screen_many(self, p: np.ndarray, q: np.ndarray, by_length: bool = False) -> list[str | None]:
        """Why each route is not accepted by the land mask, else None; the first reason counts.

        In order: a part outside the support (with the tolerance around it), a length within the land that is as far as the
        uncertainty from its shore and long enough, anything within the uncertainty of the land. All routes at once, as
        unions of intervals; only edges whose boxes come near a route are looked at.
        A route that stays at one point within the land crosses it whatever its length. by_length: its length, zero, decides as for others.
        """
        out = np.full(len(p), None, dtype=object)
        point = (p == q).all(axis=1)
        for at, judge in ((np.flatnonzero(point), self._screen_points), (np.flatnonzero(~point), self._screen_lines)):
            for some in np.array_split(at, -(-len(at) // ROUTES) or 1):
                if len(some):
                    out[some] = judge(p[some], q[some], by_length)
        return out.tolist()

    def _screen_points(self, p: np.ndarray, _: np.ndarray, by_length: bool) -> np.ndarray:
        c = self.config
        outside = ~self.support.inside(p) & (self.support.away(p, c.numerical_tolerance_m) > c.numerical_tolerance_m)
        inside, away = self.land.inside(p), self.land.away(p, c.shoreline_uncertainty_m)
        deep = inside & (away >= c.shoreline_uncertainty_m) & (not by_length)
        return self._first_reason(outside, deep, inside | (away <= c.shoreline_uncertainty_m))

    def _screen_lines(self, p: np.ndarray, q: np.ndarray, _: bool) -> np.ndarray:
        c, n, d = self.config, len(p), q - p
        length = np.hypot(*d.T)
        whole = lambda *parts: covered(*map(np.concatenate, zip(*parts)), n) * length
        supported = self._within(p, q, self.support), near_many(p, d, *self._near(p, q, self.support, c.numerical_tolerance_m))
        outside = length - whole(*supported) > 1e-9
        land, shore = self._within(p, q, self.land), near_many(p, d, *self._near(p, q, self.land, c.shoreline_uncertainty_m))
        deep = whole(land, shore) - whole(shore)
        touched = np.zeros(n, dtype=bool)
        touched[land[0]] = touched[shore[0]] = True
        return self._first_reason(outside, (deep > 1e-9) & (deep >= c.material_land_crossing_m), touched)

    @staticmethod
    def _near(p: np.ndarray, q: np.ndarray, edges: Edges, distance: float) -> tuple[np.ndarray, Edges, np.ndarray, float]:
        route, edge = edges.around(p, q, distance)
        return route, edges, edge, distance

    @staticmethod
    def _within(p: np.ndarray, q: np.ndarray, edges: Edges) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(route, from, to) of the pieces of moving routes inside the rings, cut at every edge they meet."""
        n, d = len(p), q - p
        route, edge = edges.around(p, q, 0.0)
        at, t = cuts_many(p, d, route, edges, edge)
        who, t = np.concatenate([np.arange(n), np.arange(n), at]), np.concatenate([np.zeros(n), np.ones(n), t])
        order = np.lexsort((t, who))
        who, t = who[order], t[order]
        piece = np.flatnonzero((who[1:] == who[:-1]) & (t[1:] > t[:-1]))
        who, low, high = who[piece], t[piece], t[piece + 1]
        inside = edges.inside(p[who] + ((low + high) / 2)[:, None] * d[who])
        return who[inside], low[inside], high[inside]

    @staticmethod
    def _first_reason(outside: np.ndarray, deep: np.ndarray, touched: np.ndarray) -> np.ndarray:
        out = np.where(touched, "shoreline_uncertainty", None).astype(object)
        out[deep] = "material_land_crossing"
        out[outside] = "water_mask_unavailable"
        return out

    def require_cover(self) -> None:
        """The area has no gap between its cells: beside each edge of a cell or of the area, what is in the area is in a cell."""
        for edges in (self.cell_edges, self.aoi):
            pieces = 1 if edges is self.cell_edges else 16
            t = np.arange(pieces)[:, None, None] / pieces
            a = (edges.a + t * edges.d).reshape(-1, 2)
            d = np.tile(edges.d / pieces, (pieces, 1))
            beside = 2 * self.config.numerical_tolerance_m * np.stack([-d[:, 1], d[:, 0]], axis=1) / np.hypot(*d.T)[:, None]
            for at in np.array_split(np.arange(len(a)), -(-len(a) // ROUTES)):
                for shift in (beside[at], -beside[at]):
                    self.parts_many(a[at] + shift, a[at] + d[at] + shift)

    def parts_column(self, x1: Column, y1: Column, x2: Column, y2: Column, exact: bool = False) -> Column:
        """array<struct<lo, hi, cell>> of each route, as parts_many has them; an Arrow function, as built-ins have no geometry."""

        @F.arrow_udf("array<struct<lo:double,hi:double,cell:string>>")
        def clip(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
            p, q, ok = ends_of(a, b, c, d)
            found = [self._parts(p[at], q[at], exact) for at in np.array_split(np.flatnonzero(ok), -(-len(ok) // ROUTES) or 1)]
            sizes, lo, hi, owner = (np.concatenate(x) for x in zip(*found))
            offsets = np.zeros(len(ok) + 1, dtype=np.int32)
            offsets[1:][ok] = sizes
            names = pa.array([*self.cells, None], pa.string()).take(pa.array(owner))
            parts = pa.StructArray.from_arrays([pa.array(lo), pa.array(hi), names], ["lo", "hi", "cell"])
            return pa.ListArray.from_arrays(pa.array(np.cumsum(offsets, dtype=np.int32)), parts, mask=pa.array(~ok))

        return clip(x1, y1, x2, y2)

    def exact_parts_column(self, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
        return self.parts_column(x1, y1, x2, y2, exact=True)

    def candidates_column(self, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
        """The ids of the cells whose boxes come within the tolerance of each route's box, in order."""

        @F.arrow_udf("array<string>")
        def find(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
            p, q, ok = ends_of(a, b, c, d)
            route, cell = self.candidate_pairs(p[ok], q[ok])
            offsets = np.zeros(len(ok) + 1, dtype=np.int32)
            offsets[1:][ok] = np.bincount(route, minlength=int(ok.sum()))
            return pa.ListArray.from_arrays(pa.array(np.cumsum(offsets, dtype=np.int32)), pa.array(self.cells, pa.string()).take(pa.array(cell)), mask=pa.array(~ok))

        return find(x1, y1, x2, y2)

    def screen_column(self, x1: Column, y1: Column, x2: Column, y2: Column, by_length: bool = False) -> Column:
        @F.arrow_udf("string")
        def judge(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
            p, q, ok = ends_of(a, b, c, d)
            out = np.full(len(ok), None, dtype=object)
            if ok.any():
                out[ok] = self.screen_many(p[ok], q[ok], by_length)
            return pa.array(out, pa.string())

        return judge(x1, y1, x2, y2)

    def length_screen_column(self, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
        return self.screen_column(x1, y1, x2, y2, by_length=True)

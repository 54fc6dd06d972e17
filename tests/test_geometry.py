import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.functions.projection import LocalProjection
from wakeline.operators.boxes import PackedBoxes, meeting
from wakeline.operators.geometry import Tile, TileConfig, covered, merged_cuts, misplaced, rings_of
from wakeline.plans.grid import GRID, geographic

P = LocalProjection(20.0, 10.0, 50_000.0, 0.007)


def ring(*points):
    return [geographic(*p) for p in (*points, points[0])]


def box(x0, y0, x1, y1):
    return {"type": "Polygon", "coordinates": [ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))]}


def tile(land=None, cells=None, aoi=None):
    cells = cells or [("a", ring((-3000, -3000), (0, -3000), (0, 3000), (-3000, 3000))), ("b", ring((0, -3000), (3000, -3000), (3000, 3000), (0, 3000)))]
    land = land or {"type": "MultiPolygon", "coordinates": []}
    return Tile(TileConfig(P, 7), aoi or box(-2000, -2000, 2000, 2000), land, box(-10_000, -10_000, 10_000, 10_000), cells)


def clip(t, *route):
    p, q = np.array([route[:2]], float), np.array([route[2:]], float)
    return t.parts_many(p, q)[0]


def test_straight_route_is_split_at_area_and_cells():
    parts = clip(tile(), -4000, 0, 4000, 0)
    assert [c for _, _, c in parts] == [None, None, "a", "b", None, None]
    assert np.allclose([a for a, _, _ in parts], [0, 0.125, 0.25, 0.5, 0.75, 0.875], atol=1e-9) and parts[-1][1] == 1


def test_ties_go_to_the_smaller_id_and_points_have_one_part():
    t = tile()
    assert clip(t, 0, 0, 0, 0) == [(0.0, 1.0, "a")]
    assert [c for _, _, c in clip(t, 0, -1000, 0, 1000)] == ["a"]
    assert clip(t, 5000, 0, 5000, 0) == [(0.0, 1.0, None)]


def test_slivers_merge():
    parts = clip(tile(), -0.0004, 0, 1000, 0)
    assert parts[0][0] == 0 and len(parts) == 1


def test_exact_parts_keep_slivers_and_belong_to_the_cell_they_lie_in():
    """A route that cuts a corner by 1.2 mm: the piece lies within the tolerance of the opposite cell, whose id is smaller."""
    at = (-6909.898379905999, -433.00023658817514, 3625.378017778316, -7349.8155421473175)
    names = lambda exact: [c for _, _, c in GRID.parts_many(np.array([at[:2]]), np.array([at[2:]]), exact=exact)[0]]
    assert names(False) == ["r02c00", "r02c01", "r01c01", "r01c02", "r01c03", "r00c03", "r00c04"]
    assert names(True) == ["r02c00", "r02c01", "r02c02", "r01c02", "r01c03", "r00c03", "r00c04"]
    exact = lambda *r: tile().parts_many(np.array([r[:2]], float), np.array([r[2:]], float), exact=True)[0]
    assert [c for _, _, c in exact(-0.0004, 0, 1000, 0)] == ["a", "b"]
    assert [c for _, _, c in exact(0, -1000, 0, 1000)] == ["a"] and exact(0, 0, 0, 0) == [(0.0, 1.0, "a")]


def test_merged_cuts_equal_one_by_one():
    rng = np.random.default_rng(8)
    who = np.repeat(np.arange(300), rng.integers(2, 12, 300))
    t = np.round(rng.random(len(who)), 1) + rng.choice([0, 1e-4, 3e-4, 1.2e-3], len(who))
    first = np.concatenate(([True], who[1:] != who[:-1]))
    t[first], t[np.append(first[1:], True)] = 0.0, 1.0
    t = np.minimum(t, 1.0)
    t = t[np.lexsort((t, who))]
    length = rng.choice([0.0, 1.0, 3.0], 300)
    want = []
    for i in range(300):
        own, kept = t[who == i], [0.0]
        for x in own[1:-1].tolist():
            if (x - kept[-1]) * length[i] > 1e-3 and x < 1:
                kept.append(x)
        want += [*kept, 1.0]
    assert t[merged_cuts(who, t, length, 1e-3)].tolist() == want


def test_uncovered_area_is_an_error():
    with pytest.raises(ValueError):
        clip(tile(cells=[("a", ring((-3000, -3000), (0, -3000), (0, 3000), (-3000, 3000)))]), 500, 0, 1500, 0)


def test_hexagons_agree_with_convex_clipping():
    rng = np.random.default_rng(3)
    cells, r = [], 900.0
    for i in range(-4, 5):
        for j in range(-4, 5):
            cx, cy = i * 1.5 * r, (j + (i % 2) / 2) * np.sqrt(3) * r
            pts = [(cx + r * np.cos(k * np.pi / 3), cy + r * np.sin(k * np.pi / 3)) for k in range(6)]
            cells.append((f"h{i + 4}{j + 4}", ring(*pts)))
    t = tile(cells=cells)
    for _ in range(40):
        p, q = rng.uniform(-5000, 5000, 2), rng.uniform(-5000, 5000, 2)
        got: dict = {}
        for a, b, c in clip(t, *p, *q):
            got[c] = got.get(c, 0) + b - a
        for name, shape in zip(t.cells, t.shapes):
            lo, hi = 0.0, 1.0
            planes = [(shape.a[k], shape.b[k]) for k in range(6)] + [(np.array(x), np.array(y)) for x, y in zip(
                [(-2000, -2000), (2000, -2000), (2000, 2000), (-2000, 2000)], [(2000, -2000), (2000, 2000), (-2000, 2000), (-2000, -2000)])]
            for a, b in planes:
                n = np.array([a[1] - b[1], b[0] - a[0]])
                s, v = (p - a) @ n, (q - p) @ n
                if abs(v) < 1e-12:
                    lo, hi = (lo, hi) if s >= 0 else (1.0, 0.0)
                elif v > 0:
                    lo = max(lo, -s / v)
                else:
                    hi = min(hi, -s / v)
            assert abs(max(0.0, hi - lo) - got.get(name, 0.0)) < 1e-6


def plain_inside(edges, p):
    odd = False
    for (ax, ay), (bx, by) in zip(edges.a, edges.b):
        if (ay > p[1]) != (by > p[1]) and ax + (p[1] - ay) * (bx - ax) / (by - ay) > p[0]:
            odd = not odd
    return odd


def plain_distance(a, b, p):
    t = min(1.0, max(0.0, (p - a) @ (b - a) / ((b - a) @ (b - a))))
    return float(np.hypot(*(a + t * (b - a) - p)))


def plain_screen(t, p, q, steps=4000):
    """The land mask's verdict by samples of the route; also whether it is too close to call."""
    c, length = t.config, float(np.hypot(*(q - p)))
    at = [p + s * (q - p) for s in ((np.arange(steps) + 0.5) / steps if length else [0.0])]
    away = lambda edges, x: min((plain_distance(a, b, x) for a, b in zip(edges.a, edges.b)), default=np.inf)
    state = [(plain_inside(t.support, x), plain_inside(t.land, x), away(t.land, x)) for x in at]
    step = length / steps
    outside = sum(not s for s, _, _ in state) * step
    deep = sum(i and d >= c.shoreline_uncertainty_m for _, i, d in state) * step
    touched = any(i or d <= c.shoreline_uncertainty_m for _, i, d in state)
    closest = min(abs(d - c.shoreline_uncertainty_m) for _, _, d in state)
    close = 0 < outside < 2 * step or abs(deep - c.material_land_crossing_m) < 3 * step or (not touched and closest < step)
    if not length:
        outside, deep = outside or not state[0][0], c.material_land_crossing_m if state[0][1] and state[0][2] >= c.shoreline_uncertainty_m else 0
        return ("water_mask_unavailable" if outside else "material_land_crossing" if deep else "shoreline_uncertainty" if touched else None), False
    verdict = "water_mask_unavailable" if outside else "material_land_crossing" if deep >= c.material_land_crossing_m else "shoreline_uncertainty" if touched else None
    return verdict, close


def test_screen():
    t = tile(land=box(-100, -500, 100, 500))
    screen = lambda *r: t.screen_many(np.array([r[:2]], float), np.array([r[2:]], float))[0]
    assert screen(-1000, 0, 1000, 0) == "material_land_crossing"
    assert screen(-1000, 501, 1000, 501) == "shoreline_uncertainty"
    assert screen(-1000, 600, 1000, 600) is None
    assert screen(-1000, 0, 20_000, 0) == "water_mask_unavailable"
    assert screen(0, 0, 0, 0) == "material_land_crossing" and screen(101, 0, 101, 0) == "shoreline_uncertainty"


def test_screen_agrees_with_samples_of_each_route():
    rng = np.random.default_rng(5)
    jagged = [(300 * np.cos(k) * (1 + k % 2), 300 * np.sin(k) * (1 + k % 2)) for k in np.linspace(0, 2 * np.pi, 9)[:-1]]
    holed = {"type": "Polygon", "coordinates": [ring((-400, -400), (400, -400), (400, 400), (-400, 400)), ring((-200, -200), (200, -200), (200, 200), (-200, 200))]}
    for land in (box(-100, -500, 100, 500), {"type": "Polygon", "coordinates": [ring(*jagged)]}, holed, None):
        t = tile(land=land)
        p = rng.uniform(-700, 700, (60, 2))
        q = p + rng.choice([0.0, 3.0, 400.0, 12_000.0], (60, 1)) * rng.uniform(-1, 1, (60, 2))
        p[:6], q[:6] = rng.uniform(-11_000, 11_000, (6, 2)), rng.uniform(-11_000, 11_000, (6, 2))
        told = 0
        for got, a, b in zip(t.screen_many(p, q), p, q):
            want, close = plain_screen(t, a, b, 300)
            told += not close
            assert close or got == want, (a, b)
        assert told > 40


def test_covered_is_the_union_of_intervals():
    rng = np.random.default_rng(7)
    who, low = rng.integers(0, 30, 300), rng.uniform(0, 1, 300)
    high = np.minimum(1, low + rng.choice([0, 0.01, 0.3], 300))
    got = covered(who, low, high, 31)
    for i in range(31):
        want, end = 0.0, 0.0
        for a, b in sorted(zip(low[who == i].tolist(), high[who == i].tolist())):
            want += max(0.0, b - max(a, end))
            end = max(end, b)
        assert abs(got[i] - want) < 1e-12
    assert covered(who[:0], low[:0], high[:0], 3).tolist() == [0, 0, 0]


def meets(a, b):
    return (a[:, None, :2] <= b[None, :, 2:]).all(axis=2) & (b[None, :, :2] <= a[:, None, 2:]).all(axis=2)


def random_boxes(rng, n, sizes):
    low = rng.uniform(-5000, 5000, (n, 2)).round(rng.integers(0, 3))
    return np.hstack([low, low + rng.choice(sizes, (n, 1)) * rng.uniform(0, 1, (n, 2)).round(2)])


@pytest.mark.parametrize("n", [0, 1, 16, 17, 300, 10_000])
def test_packed_boxes_equal_all_pairs(n):
    rng = np.random.default_rng(n)
    boxes, queries = random_boxes(rng, n, [0.0, 10.0, 300.0]), random_boxes(rng, 200, [0.0, 50.0, 2000.0])
    who, which = PackedBoxes(boxes).pairs(queries[:, :2], queries[:, 2:])
    want = np.nonzero(meets(queries, boxes))
    assert (who == want[0]).all() and (which == want[1]).all()


def test_packed_boxes_take_time_by_hits():
    seconds = {}
    for side in (100, 1000):
        x, y = (g.ravel() * 100.0 for g in np.meshgrid(np.arange(side), np.arange(side)))
        index = PackedBoxes(np.stack([x, y, x + 100, y + 100], axis=1))
        at = np.random.default_rng(1).uniform(0, side * 100, (20_000, 2))
        began = time.process_time()
        found = len(index.pairs(at, at + 50)[0])
        seconds[side] = time.process_time() - began
        assert 20_000 < found < 80_000
    assert seconds[1000] < 5 * seconds[100] + 0.5  # a hundred times the boxes


def test_meeting_boxes_equal_all_pairs(spark):
    rng = np.random.default_rng(2)
    a, b = random_boxes(rng, 150, [0.0, 20.0, 4000.0, 100_000.0]), random_boxes(rng, 200, [0.0, 90.0, 3000.0])
    a[:20, :2], a[:20, 2:] = b[:20, 2:], b[:20, 2:] + 64.0  # corners that touch
    frame = lambda boxes: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(boxes)], "id int, x0 double, y0 double, x1 double, y1 double")
    odd = spark.createDataFrame([(-1, None, 0.0, 1.0, 1.0), (-2, 0.0, 0.0, float("inf"), 1.0), (-3, float("nan"), 0.0, 1.0, 1.0)], "id int, x0 double, y0 double, x1 double, y1 double")
    got = sorted(map(tuple, meeting(frame(a).unionByName(odd), frame(b).unionByName(odd)).collect()))
    assert got == sorted(zip(*(x.tolist() for x in np.nonzero(meets(a, b)))))
    assert meeting(frame(a), frame(b).limit(0)).count() == 0


def test_invalid_rings_are_errors():
    bow = {"type": "Polygon", "coordinates": [ring((0, 0), (100, 100), (100, 0), (0, 100))]}
    pinched = {"type": "Polygon", "coordinates": [ring((0, 0), (100, 0), (50, 50), (100, 100), (0, 100), (50, 50))]}
    overlapping = {"type": "MultiPolygon", "coordinates": [box(0, 0, 100, 100)["coordinates"], box(50, 50, 150, 150)["coordinates"]]}
    twice = {"type": "MultiPolygon", "coordinates": [box(0, 0, 100, 100)["coordinates"]] * 2}
    for bad in (bow, pinched, overlapping, twice):
        with pytest.raises(ValueError, match="cross"):
            tile(land=bad)
    tile(land={"type": "Polygon", "coordinates": [ring((0, 0), (90, 0), (90, 90), (0, 90)), ring((30, 30), (60, 30), (60, 60), (30, 60))]})
    many = [(1000 * np.cos(k / 5000 * np.pi), 1000 * np.sin(k / 5000 * np.pi)) for k in range(10_000)]
    tile(land={"type": "Polygon", "coordinates": [ring(*many)]})


def test_cover():
    tile().require_cover()
    halves = [("a", ring((-3000, -3000), (0, -3000), (0, 3000), (-3000, 3000))), ("b", ring((1, -3000), (3000, -3000), (3000, 3000), (1, 3000)))]
    for cells in (halves, halves[:1]):
        with pytest.raises(ValueError, match="no cell"):
            tile(cells=cells).require_cover()


def test_projection_round_trip(spark):
    pts = [(20.0, 10.0), (20.3, 10.2), (19.7, 9.8), (25.0, 10.0), (None, 10.0)]
    df = spark.createDataFrame(pts, "lon double, lat double")
    x, y = P.forward(F.col("lon"), F.col("lat"))
    rows = df.withColumns({"x": x, "y": y})
    lon, lat = P.inverse(F.col("x"), F.col("y"))
    out = rows.withColumns({"lon2": lon, "lat2": lat}).collect()
    assert out[0].x == 0 and out[0].y == 0
    assert all(abs(r.lon - r.lon2) < 1e-9 and abs(r.lat - r.lat2) < 1e-9 for r in out[:3])
    assert out[3].x is None and out[4].x is None
    assert 0.005 < P.metric_error_bound < 0.006
    with pytest.raises(ValueError):
        LocalProjection(20, 80, 50_000, 0.007)


def square_ring(x0, y0, x1, y1):
    return ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))


BIG, LAKE, ISLAND, POND = (square_ring(-k, -k, k, k) for k in (1000, 500, 250, 100))
ASIDE = square_ring(2000, 0, 2500, 500)


@pytest.mark.parametrize(
    "polygons",
    [
        [[BIG]], [[BIG, LAKE]], [[BIG, LAKE], [ISLAND]], [[BIG, LAKE], [ISLAND, POND]], [[ISLAND, POND], [ASIDE], [BIG, LAKE]],
        [[BIG, square_ring(-400, -400, -100, -100), square_ring(100, 100, 400, 400)]],
        [[BIG], [square_ring(1000.0005, 0, 1500, 500)]], [], [[]],
    ],
)
def test_nested_rings_that_are_right(polygons):
    assert len(rings_of({"type": "MultiPolygon", "coordinates": polygons}, P, 1000, allow_empty=True)) == sum(map(len, polygons))


@pytest.mark.parametrize(
    "polygons",
    [
        [[BIG], [LAKE]], [[LAKE], [BIG]], [[BIG, LAKE], [ISLAND], [POND]], [[BIG, ISLAND], [LAKE, POND]], [[BIG, LAKE, ISLAND]],
        [[LAKE, BIG]], [[BIG, ASIDE]], [[ASIDE], [BIG, LAKE], [square_ring(600, 600, 900, 900)]], [[], [[], LAKE]],
        [[BIG, LAKE], [ASIDE, ISLAND]],
    ],
)
def test_nested_rings_that_are_wrong(polygons):
    with pytest.raises(ValueError, match="polygon|hole"):
        rings_of({"type": "MultiPolygon", "coordinates": polygons}, P, 1000, allow_empty=True)


def test_rings_that_touch_in_points():
    """The corners of the inner square lie on the edges of the outer one, its edges' middles don't (metres, as degrees would be rounded)."""
    outer = [(-8.0, -8.0), (8.0, -8.0), (8.0, 8.0), (-8.0, 8.0), (-8.0, -8.0)]
    inner = [(8.0, 0.0), (0.0, 8.0), (-8.0, 0.0), (0.0, -8.0), (8.0, 0.0)]
    small = [(x / 4, y / 4) for x, y in outer]
    for rings, owner, wrong in (
        ([outer, inner], [0, 0], False), ([outer, inner, small], [0, 0, 1], False), ([outer, inner], [0, 1], True), ([inner, outer], [0, 0], True),
        ([outer, inner, small], [0, 0, 0], True), ([inner, small, outer], [0, 0, 1], True),
    ):
        assert misplaced(rings, np.array(owner)) == wrong, (rings, owner)


def test_many_polygons_are_checked_in_short_time():
    """900 islands, each with a lake, and one polygon in one of the islands."""
    at = [(x * 100.0, y * 100.0) for x in range(-15, 15) for y in range(-15, 15)]
    polygons = [[square_ring(x, y, x + 80, y + 80), square_ring(x + 30, y + 30, x + 60, y + 60)] for x, y in at]
    start = time.perf_counter()
    assert len(rings_of({"type": "MultiPolygon", "coordinates": polygons}, P, 20_000)) == 1800
    assert time.perf_counter() - start < 10
    with pytest.raises(ValueError, match="polygon"):
        rings_of({"type": "MultiPolygon", "coordinates": [*polygons, [square_ring(5, 5, 20, 20)]]}, P, 20_000)


def test_routes_are_clipped_once(spark):
    """The clip function stands once in the plan of each query that needs it."""
    from wakeline.plans.queries import QUERIES

    for name in ("speed_bands", "daily_metrics", "daily_export"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1, name

"""Outlines and four-corner boxes on drawn shapes."""

import numpy as np
import pytest

from agrispark.operators import contours
from agrispark.operators.polygons import hull


def drawn(text):
    rows = text.split()
    return np.array([(x, y) for y, row in enumerate(rows) for x, c in enumerate(row) if c == "#"])


def filled(corners, size=60):
    """Pixels whose centre is in a convex polygon."""
    y, x = np.mgrid[0:size, 0:size]
    inside = np.ones((size, size), bool)
    for (ax, ay), (bx, by) in zip(corners, np.roll(corners, -1, axis=0), strict=True):
        inside &= (bx - ax) * (y - ay) - (by - ay) * (x - ax) >= 0
    return np.argwhere(inside)[:, ::-1]


def brute_boundary(px):
    """Pixels from which the outside is reached through a side (the outer boundary of an 8-connected set)."""
    have = {tuple(p) for p in px.tolist()}
    lo, hi = px.min(0) - 1, px.max(0) + 1
    out, todo = set(), [tuple(lo.tolist())]
    while todo:
        x, y = todo.pop()
        if (x, y) in out or (x, y) in have or not (lo[0] <= x <= hi[0] and lo[1] <= y <= hi[1]):
            continue
        out.add((x, y))
        todo += [(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)]
    return {p for p in have if any(q in out for q in ((p[0] + 1, p[1]), (p[0] - 1, p[1]), (p[0], p[1] + 1), (p[0], p[1] - 1)))}


def between(ring):
    """All pixels on the stretches of an outline."""
    out = set()
    for a, b in zip(ring, np.roll(ring, -1, axis=0), strict=True):
        n = int(np.abs(b - a).max())
        out |= {tuple((a + (b - a) * k // max(n, 1)).tolist()) for k in range(n + 1)}
    return out


@pytest.mark.parametrize("text", ["#", "##", "#. .#", "### #.# ###", ".#. ### .#.", "####. #..#. ####. ...## ....#", "#...# .#.#. ..#.. .#.#. #...#", "##### #...# #.#.# #...# #####"])
def test_outline_is_the_outer_boundary(text):
    px = drawn(text)
    assert between(contours.outline(px)) == brute_boundary(px)


def test_outline_of_random_blobs():
    r = np.random.default_rng(3)
    for _ in range(60):
        grid = np.zeros((14, 14), bool)
        at = np.array([7, 7])
        for _ in range(80):
            grid[tuple(at)] = True
            at = np.clip(at + r.integers(-1, 2, 2), 0, 13)
        px = np.argwhere(grid)
        ring = contours.outline(px)
        assert between(ring) == brute_boundary(px)
        steps = np.diff(np.vstack([ring, ring[:1]]), axis=0)
        assert ((np.abs(steps).max(1) == np.abs(steps).sum(1)) | (np.abs(steps[:, 0]) == np.abs(steps[:, 1]))).all() or len(ring) == 1


def test_simplified_stays_within_the_tolerance():
    r = np.random.default_rng(8)
    for _ in range(40):
        angle = np.sort(r.uniform(0, 2 * np.pi, 30))
        ring = np.round(np.column_stack([np.cos(angle), np.sin(angle)]) * r.uniform(5, 20, (30, 1))).astype(int)
        few = contours.simplified(ring, 2.0)
        assert {tuple(p) for p in few.tolist()} <= {tuple(p) for p in ring.tolist()}
    square = np.array([(0, 0), (5, 0), (10, 0), (10, 10), (5, 10), (0, 10), (0, 5)])
    assert sorted(map(tuple, contours.simplified(square, 0.5).tolist())) == [(0, 0), (0, 10), (10, 0), (10, 10)]


@pytest.mark.parametrize("method", ["rectangle", "hull", "contour"])
def test_turned_quads_come_back(method):
    for turn in (0, 17, 40, 70):
        c, s = np.cos(np.radians(turn)), np.sin(np.radians(turn))
        box = np.array([(-18, -9), (18, -9), (18, 9), (-18, 9)]) @ np.array([[c, s], [-s, c]]) + 30
        got = contours.four_corners(filled(box), method)
        assert all(np.hypot(*(got - p).T).min() < 2.3 for p in box)
        assert got[0, 1] <= got[3, 1] and got[1, 1] <= got[2, 1] and got[0, 0] <= got[1, 0]


def test_hull_and_contour_differ_where_a_shape_is_hollow():
    arrow = filled(np.array([(5, 5), (55, 30), (5, 55)]))
    arrow = arrow[~((arrow[:, 0] < 25) & (np.abs(arrow[:, 1] - 30) < 25 - arrow[:, 0]))]  # a notch at the left
    notched = contours.four_corners(arrow, "contour")
    assert any(abs(x - 25) <= 3 and abs(y - 30) <= 3 for x, y in notched.tolist())
    assert (contours.four_corners(arrow, "hull") == contours.four_corners(arrow, "rectangle")).all()  # a triangle: three corners
    assert len(contours.simplified(hull(contours.outline(arrow)), 2.0)) == 3


def test_small_shapes_and_odd_rows(spark):
    rows = [(1, 3, 4, "x"), (1, 3, 4, "y"), (2, 0, 0, "x"), (2, 19, 19, "x"), (None, 1, 1, "x"), (3, None, 2, "x")]
    px = spark.createDataFrame(rows, "seg_id long, x int, y int, method string")
    got = {r.seg_id: tuple(r)[1:] for r in contours.segment_quads(px).collect()}
    assert got[1] == (0.15, 0.2) * 4 and set(got) == {1, 2}
    assert contours.segment_quads(px.limit(0)).count() == 0
    with pytest.raises(ValueError):
        contours.segment_quads(px, "circle")


def test_many_segments_come_in_one_call(spark):
    """All methods from one outline: the same as each segment alone, in one shuffle and one Python step."""
    r = np.random.default_rng(8)
    walks = [np.cumsum(r.integers(-1, 2, (int(r.integers(3, 30)), 2)), axis=0) for _ in range(40)]  # 8-connected
    shapes = [s - s.min(0) for s in (np.unique(w, axis=0) for w in walks) if np.ptp(s, axis=0).max() < 20] * 5
    methods = ["hull", "contour", "rectangle"]
    rows = [(i, int(x) + 20 * i, int(y) + 40) for i, s in enumerate(shapes) for x, y in s] + [(0, int(shapes[0][0][0]), 40 + int(shapes[0][0][1]))]
    found = contours.quads_by_method(spark.createDataFrame(rows, "seg_id long, x int, y int"), methods)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "FlatMapGroupsInPandas" not in plan
    got = {(q.method, q.seg_id): tuple(q)[2:] for q in found.collect()}
    assert len(got) == 3 * len(shapes)
    for i, s in enumerate(shapes):
        for m in methods:
            assert got[m, i] == pytest.approx(np.clip(contours.four_corners(s, m) / 20, 0, 1).ravel().tolist())

"""Boxes within a union of grown truths, against a fine grid and known shapes."""

import numpy as np

from agrispark.operators.coverage import covered, within_union

KIND = "minx double, miny double, maxx double, maxy double"


def by_grid(box, grown, buffer, steps=160):
    x, y = np.meshgrid(np.linspace(box[0], box[2], steps), np.linspace(box[1], box[3], steps))
    dx = np.maximum(np.maximum(grown[:, 0] - x[..., None], x[..., None] - grown[:, 2]), 0)
    dy = np.maximum(np.maximum(grown[:, 1] - y[..., None], y[..., None] - grown[:, 3]), 0)
    return buffer - np.hypot(dx, dy).min(axis=2).max()  # under 0: an uncovered point, and how far


def test_known_shapes():
    at = lambda *b: np.array(b, float)
    two = np.array([[0, 0, 1, 1], [2, 0, 3, 1]], float)
    assert covered(at(0, 0, 3, 1), two, 0.5) and not covered(at(0, 0, 3, 1), two, 0.49)
    assert not covered(at(0, -0.1, 3, 1.1), two, 0.5)  # the round corners leave a notch where the sides just meet
    assert covered(at(0, 0, 3, 1.5), two, 1.0) and not covered(at(0, 0, 3, 2.0), two, 1.0)
    ring = np.array([[0, 0, 5, 1], [0, 4, 5, 5], [0, 0, 1, 5], [4, 0, 5, 5]], float)
    assert not covered(at(0, 0, 5, 5), ring, 1.4) and covered(at(0, 0, 5, 5), ring, 1.5)  # a hole in the middle
    assert covered(at(1, 1, 1, 1), two, 0.0) and not covered(at(1.5, 0, 1.5, 0), two, 0.4) and covered(at(1.5, 0, 1.5, 1), two, 0.5)
    discs = np.array([[0, 0, 0, 0], [2, 0, 2, 0], [1, 3**0.5, 1, 3**0.5]])  # three discs that touch leave a hole
    assert not covered(at(0.9, 0.4, 1.1, 0.7), discs, 1.0) and covered(at(0.9, 0.4, 1.1, 0.7), discs, 1.16)


def test_random_boxes_agree_with_a_grid(spark):
    r = np.random.default_rng(4)
    low = r.uniform(0, 4, (60, 2))
    truths = np.hstack([low, low + r.uniform(0, 0.6, (60, 2))])
    low = r.uniform(0, 3.5, (150, 2))
    boxes = np.hstack([low, low + r.uniform(0, 1.3, (150, 2))])
    a = spark.createDataFrame([(i, *map(float, b)) for i, b in enumerate(boxes)], f"id int, {KIND}")
    b = spark.createDataFrame([tuple(map(float, t)) for t in truths], KIND)
    for buffer, size in ((0.3, 1.0), (0.45, 0.4)):
        got = {x.id: x.inside for x in within_union(a, b, buffer, "id", size).collect()}
        margins = [by_grid(box, truths, buffer) for box in boxes]
        assert sorted(got) == list(range(150)) and 0 < sum(got.values()) < 150
        assert all(got[i] == (m >= 0) for i, m in enumerate(margins) if abs(m) > 0.01)


def test_dense_places_are_halved():
    r = np.random.default_rng(6)
    low = r.uniform(0, 2, (500, 2))
    dense = np.hstack([low, low])  # points
    found = []
    for _ in range(60):
        low = r.uniform(0.2, 1.2, 2)
        box = np.hstack([low, low + r.uniform(0.05, 0.6, 2)])
        buffer = float(r.uniform(0.05, 0.12))
        margin = by_grid(box, dense, buffer)
        if abs(margin) > 0.004:
            got = covered(box, dense, buffer)
            assert got == (margin > 0)
            found.append(got)
        few = dense[:20]
        assert covered(box, few, 0.4) == (by_grid(box, few, 0.4) > 0) or abs(by_grid(box, few, 0.4)) < 0.01
    assert 0 < sum(found) < len(found) > 20


def test_odd_rows(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), (2, None, 0.0, 1.0, 1.0), (3, 9.0, 9.0, 9.5, 9.5), (1, 0.0, 0.0, 1.0, 1.0)], f"id int, {KIND}")
    b = spark.createDataFrame([(0.0, 0.0, 0.4, 1.0), (0.6, 0.0, 1.0, 1.0), (0.6, 0.0, 1.0, 1.0), (None, 0.0, 1.0, 1.0)], KIND)
    assert sorted(map(tuple, within_union(a, b, 0.1, "id").collect())) == [(1, 1), (2, 0), (3, 0)]
    assert [r.inside for r in within_union(a, b.limit(0), 0.1, "id").collect()] == [0, 0, 0]
    assert within_union(a.limit(0), b, 0.1, "id").count() == 0

"""Many small groups in one call, against the same groups one by one."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from agrispark.operators import chunks, matching, models, polygons, spatial


def test_batches_are_cut_between_groups():
    keys = np.repeat(np.arange(40), np.r_[np.full(20, 1), np.full(19, 7), 60])
    rows = pd.DataFrame({"k": keys, "v": np.arange(len(keys))})
    for step in (1, 3, 10, 50, 1000):
        out = list(chunks.whole_groups((rows[i : i + step] for i in range(0, len(rows), step)), ["k"]))
        assert pd.concat(out, ignore_index=True).equals(rows)
        assert sum(c["k"].nunique() for c in out) == 40 and all(len(c) for c in out)
    assert len(list(chunks.whole_groups(iter([rows]), ["k"]))) <= 2
    assert list(chunks.whole_groups(iter([rows[:0]]), ["k"])) == []


def test_hulls_and_rectangles_of_many_groups():
    rng = np.random.default_rng(3)
    group = np.sort(rng.integers(0, 300, 2000))
    points = rng.integers(0, 12, (2000, 2)) / 4
    who, at = polygons.hulls(group, points)
    for g in np.unique(group):
        one = polygons.hull(points[group == g])
        assert (at[who == g] == one).all()
        mine, plain = (sorted(np.round(r, 6).tolist()) for r in (polygons.rectangles(one[None])[0], polygons.rectangle(one)))  # corners of one height may swap
        np.testing.assert_allclose(mine, plain, atol=2e-6)


def _layer(spark, n=3000):
    rng = np.random.default_rng(8)
    at, size = rng.integers(0, 2560, (n, 2)) / 64, rng.integers(8, 64, (n, 2)) / 64
    rows = [(i, 0, float(x), float(y), float(x + w), float(y + h), i % 100 / 100) for i, ((x, y), (w, h)) in enumerate(zip(at.tolist(), size.tolist(), strict=True))]
    return spark.createDataFrame(rows, "pred_id long, class_id int, minx double, miny double, maxx double, maxy double, conf double")


def test_merging_calls_python_by_chunks_and_not_by_groups(spark, monkeypatch):
    """A layer of thousands of small groups: before, each of them was a call of its own."""
    layer = _layer(spark)
    for df in (polygons.merge_to_rectangles(layer, "pred_id", 0.4), spatial.merge_greedy(layer, "pred_id", 0.1)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroupsInPandas" not in plan and "MapInPandas" in plan
    merged = polygons.merge_to_rectangles(layer, "pred_id", 0.4)
    boxes = {r.pred_id: r for r in layer.collect()}
    comp = {r.id: r.component for r in spatial.overlap_graph(spatial.box_pairs(layer, layer).where("pred_id < b_pred_id").where(spatial.overlap_ratio() >= 0.4), "pred_id", "b_pred_id").collect()}
    groups: dict[int, list] = {}
    for k, b in boxes.items():
        groups.setdefault(comp.get(k, k), []).append(b)
    got = {r.group_id: r for r in merged.collect()}
    assert got.keys() == groups.keys() and len(got) > 300
    for g, members in groups.items():
        corners = np.array([[x, y] for b in members for x in (b.minx, b.maxx) for y in (b.miny, b.maxy)])
        assert got[g].n == len(members)
        np.testing.assert_allclose(sorted([round(p.x, 6), round(p.y, 6)] for p in got[g].ring), sorted(np.round(polygons.rectangle(polygons.hull(corners)), 6).tolist()), atol=2e-6)


def test_single_boxes_with_odd_bounds(spark):
    """Null bounds and boxes without width keep the rectangle of the corners that they have; ids that repeat are one group."""
    rows = [(1, 0, 0.0, 0.0, 0.0, 2.0, 0.5), (2, 0, None, 5.0, 6.0, 7.0, 0.5), (3, 0, 20.0, 20.0, 21.0, 21.0, 0.1), (3, 0, 30.0, 30.0, 31.0, 31.0, 0.2)]
    layer = spark.createDataFrame(rows, "pred_id long, class_id int, minx double, miny double, maxx double, maxy double, conf double")
    got = {r.group_id: r for r in polygons.merge_to_rectangles(layer, "pred_id", 0.4).select("group_id", "n", F.col("ring.x").alias("x"), F.col("ring.y").alias("y")).collect()}
    assert (got[1].x, got[1].y) == ([0, 0, 0, 0], [0, 0, 2, 2])
    assert (got[2].x, got[2].y) == ([6, 6, 6, 6], [5, 5, 7, 7])
    assert got[3].n == 2
    np.testing.assert_allclose(sorted(got[3].x), sorted([20.0, 21.0, 31.0, 30.0]), atol=1.1)


def test_matching_calls_python_by_chunks_and_counts_as_matching_each_threshold(spark):
    pred = _layer(spark, 400)
    gt = _layer(spark, 200).select(F.col("pred_id").alias("gt_id"), "class_id", F.col("minx") + 0.05, "miny", F.col("maxx") + 0.05, "maxy").toDF("gt_id", "class_id", "minx", "miny", "maxx", "maxy")
    swept = matching.pr_sweep(pred, gt, lowest=0.01, steps=12)
    for df in (swept, matching.one_to_one(pred, gt)):
        assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().executedPlan().toString()
    rows = {round(r.threshold, 6): (r.tp, r.fp) for r in swept.collect()}
    assert len(rows) == 12 and max(tp for tp, _ in rows.values()) > 20
    for t in np.linspace(1.0, 0.01, 12)[[0, 4, 11]].tolist():
        kept = pred.where(F.col("conf") >= t)
        tp = matching.one_to_one(kept, gt).count()
        assert rows[round(t, 6)] == (tp, kept.count() - tp)


def test_routes_stop_once_at_a_place():
    """Twenty points at each of thirty places: routes are searched among the places, and are as long as theirs."""
    rng = np.random.default_rng(5)
    spots = rng.integers(0, 1000, (30, 2)) / 8
    points = spots[rng.permutation(np.repeat(np.arange(30), 20))]
    asked = []

    def search(at):
        asked.append(len(at))
        return models.two_opt(at, models.nearest_order(at))

    route = models.by_places(points, search)
    length = lambda at: np.hypot(*np.diff(at, axis=0).T).sum()
    assert asked == [30] and sorted(route) == list(range(600))
    firsts = points[np.sort(np.unique(points, axis=0, return_index=True)[1])]
    assert abs(length(points[route]) - length(firsts[search(firsts)])) < 1e-9
    assert models.by_places(spots, search) == search(spots)
    assert models.by_places(np.zeros((4, 2)), lambda at: models.evolved(at, rng, 6, 3, 2, 0.1)[0].tolist()) == [0, 1, 2, 3]


def test_confidences_by_several_rules_come_from_one_merge(spark, monkeypatch):
    layer, runs = _layer(spark, 300), []
    graph = spatial.overlap_graph
    monkeypatch.setattr(spatial, "overlap_graph", lambda *a, **k: runs.append(1) or graph(*a, **k))
    got = {r.group_id: r for r in spatial.merge_boxes(layer, "pred_id", 0.2, confidence={"most": "max", "least": "min", "mean": "avg"}).collect()}
    assert len(runs) == 1
    for rule, name in (("max", "most"), ("min", "least"), ("avg", "mean")):
        alone = {r.group_id: r.conf for r in spatial.merge_boxes(layer, "pred_id", 0.2, confidence=rule).collect()}
        assert alone.keys() == got.keys() and all(abs(alone[g] - got[g][name]) < 1e-12 for g in alone)


def test_neighbours_are_dealt_into_tasks_of_bounded_size(spark):
    """With small tasks the graph is the same as with one; before, the number of tasks didn't follow the points."""
    rng = np.random.default_rng(4)
    points = spark.createDataFrame([(i, *p) for i, p in enumerate((rng.integers(0, 400, (500, 2)) / 8).tolist())], "id long, x double, y double")
    rows = lambda df: sorted((r.id, r.other, r["rank"]) for r in df.collect())
    assert rows(spatial.neighbour_graph(points, "id", 4, 2.0, many=20)) == rows(spatial.neighbour_graph(points, "id", 4, 2.0))

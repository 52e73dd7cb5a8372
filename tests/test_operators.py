"""Operators that SQL can't express, against brute force, known values and invariants."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from agrispark.functions import geometry
from agrispark.operators import composites, detectors, fusion, labels, learning, matching, models, polygons, ranges, segments, spatial
from agrispark.operators.components import closed_components, connected_components

BOXES = "pred_id long, class_id int, conf double, minx double, miny double, maxx double, maxy double"


def boxes(spark, n, seed, key="pred_id", spread=3.0):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x, y = (float(v) for v in r.uniform(0, spread, 2))
        rows.append((i, int(r.integers(0, 2)), float(r.uniform(0, 1)), x, y, x + float(r.uniform(0.4, 1)), y + float(r.uniform(0.4, 1))))
    return rows, spark.createDataFrame(rows, BOXES.replace("pred_id", key))


def overlap(a, b):
    w, h = min(a[5], b[5]) - max(a[3], b[3]), min(a[6], b[6]) - max(a[4], b[4])
    if w <= 0 or h <= 0 or a[1] != b[1]:
        return 0.0
    return w * h / ((a[5] - a[3]) * (a[6] - a[4]) + (b[5] - b[3]) * (b[6] - b[4]) - w * h)


def assign(gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the assignment of greatest total gain, by shortest augmenting paths with potentials."""
    if gain.shape[0] > gain.shape[1]:
        cols, rows = assign(gain.T)
        return rows, cols
    n, m = gain.shape
    cost = -gain
    u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for start in range(n):
        dist, back, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, at, base = start, -1, 0.0
        while True:
            through = base + cost[row] - u[row] - v
            better = ~done & (through < dist)
            dist[better], back[better] = through[better], at
            at = int(np.where(done, np.inf, dist).argmin())
            base, done[at] = dist[at], True
            if owner[at] < 0:
                break
            row = owner[at]
        u[start] += base
        seen = np.flatnonzero(done & (owner >= 0))
        u[owner[seen]] += base - dist[seen]
        v[done] -= base - dist[done]
        while at >= 0:
            prev = back[at]
            owner[at] = start if prev < 0 else owner[prev]
            at = prev
    cols = np.flatnonzero(owner >= 0)
    return owner[cols], cols


def test_assignment_is_optimal():
    r = np.random.default_rng(0)
    for n, m in [(1, 1), (3, 3), (2, 5), (5, 2), (4, 6), (6, 4)] * 5:
        gain = np.round(r.uniform(0, 1, (n, m)) * r.integers(0, 2, (n, m)), 2)
        i, j = assign(gain)
        assert len(set(i)) == len(i) == len(set(j)) == min(n, m)
        small = gain if n <= m else gain.T
        best = max(sum(small[a, b] for a, b in enumerate(p)) for p in permutations(range(small.shape[1]), small.shape[0]))
        assert gain[i, j].sum() == pytest.approx(best)


def brute_matches(pred, gt, least):
    gain = np.array([[overlap(p, g) for g in gt] for p in pred]).reshape(len(pred), len(gt))
    i, j = assign(gain)
    return int((gain[i, j] >= least).sum()), gain[i, j].sum()


def test_one_to_one_and_sweep_match_whole_assignment(spark):
    a, pred = boxes(spark, 40, 1)
    b, gt = boxes(spark, 30, 2, "gt_id")
    n, _ = brute_matches(a, b, 0.3)
    got = matching.one_to_one(pred, gt, 0.3).collect()
    assert len(got) == n and len({r.pred_id for r in got}) == n == len({r.gt_id for r in got})
    for r in matching.pr_sweep(pred, gt, steps=7, least=0.3).collect():
        some = [p for p in a if p[2] >= r.threshold]
        tp = brute_matches(some, b, 0.3)[0] if some else 0
        assert (r.tp, r.fp, r.fn) == (tp, len(some) - tp, len(b) - tp)
    assert 0 <= matching.average_precision(matching.pr_sweep(pred, gt)).first().ap <= 1
    assert matching.one_to_one(pred.limit(0), gt).count() == 0


def test_lists_of_pairs_gain_as_much_as_whole_tables():
    r = np.random.default_rng(5)
    for n, m in [(1, 1), (7, 7), (20, 9), (9, 20), (30, 30)] * 8:
        gain = np.round(r.uniform(0.01, 1, (n, m)), 2) * (r.random((n, m)) < r.choice([0.1, 0.3, 1.0]))
        row, col = np.nonzero(gain)
        if not len(row) or row.max() < n - 1:
            continue
        found = matching.Assignment(row, col, gain[row, col], 0.5)
        for k in r.permutation(n).tolist():
            found.add(k)
        at = found.pairs()
        i, j = assign(gain)
        assert len(set(row[at])) == len(at) == len(set(col[at]))
        assert gain[row[at], col[at]].sum() == pytest.approx(gain[i, j].sum())
        assert found.hits == (gain[row[at], col[at]] >= 0.5).sum()


def test_a_component_of_many_pairs():
    n, r = 20_000, np.random.default_rng(6)
    row = np.repeat(np.arange(n), 5)
    col = np.clip(row + np.tile(np.arange(-2, 3), n), 0, n - 1)
    _, at = np.unique(row * n + col, return_index=True)
    row, col = row[at], col[at]
    found = matching.Assignment(row, col, r.uniform(0.01, 1, len(row)))
    for k in range(n):
        found.add(k)
    u, v = np.array(found.u), np.array(found.v)
    assert (u <= 1e-9).all() and (-np.array(found.gain) - u[found.row] - v[found.col] > -1e-9).all()  # the dual of the same total: optimal
    assert -(u.sum() + v.sum()) == pytest.approx(sum(found.gain[k] for k in found.of_row.values()))


@pytest.mark.parametrize("split", [False, True])
def test_images_are_matched_by_themselves(spark, split):
    rows = [("a", 1, 0.9, 0.1, 0.1, 0.3, 0.3), ("b", 1, 0.8, 0.1, 0.1, 0.3, 0.3), ("b", 2, 0.7, 0.6, 0.6, 0.9, 0.9), (None, 3, 0.7, 0.6, 0.6, 0.9, 0.9), ("c", 1, 0.6, 0.1, 0.1, 0.3, 0.3)]
    pred = spark.createDataFrame([(*r[:2], 0, *r[2:]) for r in rows], "image string, pred_id long, class_id int, conf double, minx double, miny double, maxx double, maxy double")
    gt = spark.createDataFrame(
        [("a", 7, 0, 0.6, 0.6, 0.9, 0.9), ("b", 7, 0, 0.1, 0.1, 0.3, 0.28), ("c", 7, 1, 0.1, 0.1, 0.3, 0.3), (None, 9, 0, 0.6, 0.6, 0.9, 0.9)],
        "image string, gt_id long, class_id int, minx double, miny double, maxx double, maxy double",
    )
    assert [tuple(r)[:3] for r in matching.one_to_one(pred, gt, 0.5, on=["image"], split=split).collect()] == [("b", 1, 7)]
    best = {(r.image, r.pred_id): r.gt_id for r in spatial.best_match(pred, gt, on=["image"]).collect()}
    assert best == {("a", 1): None, ("b", 1): 7, ("b", 2): None, (None, 3): None, ("c", 1): 7}  # classes don't count here
    c = spatial.confusion(pred, gt, on=["image"]).first()
    assert (c.tp, c.fp, c.fn) == (2, 3, 2)
    s = matching.pr_sweep(pred, gt, steps=3, on=["image"], split=split).orderBy("threshold").first()
    assert (s.tp, s.fp, s.fn) == (1, 4, 3)
    assert matching.one_to_one(pred.limit(0), gt, on=["image"], split=split).count() == 0


def test_images_match_as_whole_tables_do(spark):
    images, total = [], {}
    for k in range(3):
        a, pred = boxes(spark, 25, 10 + k)
        b, gt = boxes(spark, 25, 20 + k, "gt_id")
        total[k] = brute_matches(a, b, 0.0)[1]
        images.append((pred.withColumn("image", F.lit(k)), gt.withColumn("image", F.lit(k))))
    pred, gt = (images[0][i].union(images[1][i]).union(images[2][i]) for i in (0, 1))
    for split in (False, True):
        got = {r.image: r.s for r in matching.one_to_one(pred, gt, 0.0, on=["image"], split=split).groupBy("image").agg(F.sum("iou").alias("s")).collect()}
        assert got == pytest.approx({k: v for k, v in total.items() if v})


def test_local_parts_join_up(spark):
    r = np.random.default_rng(2)
    edges = [(int(u), int(v), int(u) // 50) for u, v in r.integers(0, 400, (300, 2))] + [(5, 5, 0), (7, None, 0)]
    df = spark.createDataFrame(edges, "u long, v long, p int")
    plain = sorted(map(tuple, connected_components(df).collect()))
    assert sorted(map(tuple, connected_components(df, place=["p"]).collect())) == plain
    home = df.where("v is not null").withColumn("v", F.expr("50 * p + v % 50"))
    assert sorted(map(tuple, closed_components(home, ["p"]).collect())) == sorted(map(tuple, connected_components(home).collect()))
    named = home.select(F.concat(F.lit("n"), "u").alias("u"), F.concat(F.lit("n"), "v").alias("v"), "p")
    plain = sorted(map(tuple, connected_components(named).collect()))
    assert sorted(map(tuple, closed_components(named, ["p"]).collect())) == plain == sorted(map(tuple, connected_components(named, place=["p"]).collect()))
    assert closed_components(home.limit(0), ["p"]).count() == 0 == connected_components(home.limit(0), place=["p"]).count()


def test_images_without_truths_are_left_out(spark):
    _, pred = boxes(spark, 20, 1)
    _, gt = boxes(spark, 20, 2, "gt_id")
    named = pred.withColumn("image", F.col("pred_id") % 2)
    s = matching.evaluate(named, gt.withColumn("image", F.lit(0)), ["image"], 0.0).first()
    assert s.tp + s.fp == 10 and s.tp + s.fn == 20


def test_quads(spark):
    ring = "array<struct<x:double,y:double>>"
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    rows = [
        (0, square, square[::-1], 1.0), (1, square, [(x + 1, y) for x, y in square], 1 / 3), (2, square, [(x + 2, y) for x, y in square], 0.0),
        (3, square, [(1.0, -1.0), (3.0, 1.0), (1.0, 3.0), (-1.0, 1.0)], 0.5), (4, square, square[:1] * 4, 0.0), (5, None, square, None),
    ]
    df = spark.createDataFrame(rows, f"id int, a {ring}, b {ring}, want double")
    for r in df.withColumn("iou", polygons.quad_iou(F.col("a"), F.col("b"))).collect():
        assert r.iou == pytest.approx(r.want) if r.want is not None else not r.iou


def test_smallest_rectangles(spark):
    t = np.radians(30)
    turn = np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])
    inner = np.random.default_rng(3).uniform(0, 1, (300, 2)) * [4, 2]
    pts = np.vstack([inner, [[0, 0], [4, 0], [4, 2], [0, 2]]]) @ turn.T
    rows = [(1, float(x), float(y)) for x, y in pts] + [(2, 5.0, 5.0), (3, 0.0, 0.0), (3, 1.0, 1.0)]
    got = {r.k: np.array([[p.x, p.y] for p in r.ring]) for r in polygons.smallest_rectangles(spark.createDataFrame(rows, "k int, x double, y double"), "k").collect()}
    sides = sorted(np.linalg.norm(np.diff(np.vstack([got[1], got[1][:1]]), axis=0), axis=1))
    assert sides == pytest.approx([2, 2, 4, 4]) and (got[2] == 5).all() and len(got) == 3


def test_utm_known_and_back(spark):
    rows = [(9.0, 0.0), (9.0, 55.0), (10.5, 56.25), (7.1, 54.0), (12.0, 50.0)]
    e, n = geometry.to_utm(F.col("lon"), F.col("lat"))
    p = spark.createDataFrame(rows, "lon double, lat double").withColumns({"e": e, "n": n})
    lon, lat = geometry.from_utm(F.col("e"), F.col("n"))
    got = p.withColumns({"lon2": lon, "lat2": lat}).collect()
    assert all(r.lon2 == pytest.approx(r.lon, abs=1e-9) and r.lat2 == pytest.approx(r.lat, abs=1e-9) for r in got)
    assert got[0].e == pytest.approx(500000) and got[0].n == pytest.approx(0, abs=1e-6)
    assert got[1].n == pytest.approx(0.9996 * 6097230.3, abs=2)  # the meridian arc to 55 degrees


def test_affine_inverse_and_turn():
    a = geometry.Affine(0.25, 0.1, 5, -0.05, -0.25, 9)
    i = a @ a.inverse()
    assert [i.a, i.b, i.c, i.d, i.e, i.f] == pytest.approx([1, 0, 0, 0, 1, 0])
    r = geometry.rotated(geometry.Affine(1, 0, 0, 0, 1, 0), 20, 10, 90)
    assert [r.a * 10 + r.b * 5 + r.c, r.d * 10 + r.e * 5 + r.f] == pytest.approx([10, 5])


def test_rings_and_odd_ones(spark):
    ring = "array<struct<x:double,y:double>>"
    rows = [(1, [(0.0, 0.0), (3.0, 0.0), (3.0, 2.0), (0.0, 2.0)]), (2, [(0.0, 0.0), (1.0, 1.0)]), (3, None), (4, [])]
    got = segments.pixels_in_rings(spark.createDataFrame(rows, f"ring_id int, ring {ring}")).collect()
    assert sorted((r.ring_id, r.x, r.y) for r in got) == [(1, x, y) for x in range(3) for y in range(2)]


def test_flat_and_null_channels_are_zero(spark):
    px = spark.createDataFrame([(0, 0, 7, None), (0, 0, 7, None)], "tile_row int, tile_col int, nir int, red int")
    assert [(r.nir, r.red) for r in composites.band_stack(px, ["nir", "red"]).collect()] == [(0, 0)] * 2
    with pytest.raises(ValueError):
        composites.composite(px, "no such")


def cloud(spark, n=600, outliers=12):
    r = np.random.default_rng(5)
    pts = np.vstack([r.normal(0, 1, (n - outliers, 2)), r.uniform(8, 12, (outliers, 2))])
    return pts, spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "id long, a double, b double")


@pytest.mark.parametrize("kind", ["mixture", "forest", "one_class"])
def test_detectors_rank_outliers_last(spark, kind):
    _, df = cloud(spark)
    if kind == "mixture":
        model, _ = learning.fit_mixture(df.where("id < 588"), ["a", "b"], 2, 1)
        s = df.select("id", learning.mixture_score(model, ["a", "b"]).alias("score"))
    elif kind == "forest":
        s = learning.forest_scores(df, ["a", "b"], "id", *learning.fit_forest(df, ["a", "b"], "id", trees=60))
    else:
        s = df.select("id", learning.one_class_score(["a", "b"], learning.fit_one_class(df.where("id < 588"), ["a", "b"])).alias("score"))
    last = [r.id for r in s.orderBy("score").limit(30).collect()]
    assert len([i for i in last if i >= 588]) >= 10


def test_mixture_density_is_that_of_its_parts(spark):
    pts, df = cloud(spark, 200, 20)
    model, _ = learning.fit_mixture(df, ["a", "b"], 2, 1)
    got = np.array([r.s for r in df.orderBy("id").select(learning.mixture_score(model, ["a", "b"]).alias("s")).collect()])
    want = np.zeros(len(pts))
    for w, g in zip(model.weights, model.gaussians):
        m, c = g.mean.toArray(), g.cov.toArray()
        d = pts - m
        want += w * np.exp(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d)) / np.sqrt(np.linalg.det(2 * np.pi * c))
    ok = want > 1e-250
    assert got[ok] == pytest.approx(np.log(want[ok]), abs=1e-5)


def test_components_and_shrinkage(spark):
    pts, df = cloud(spark)
    mean, vectors, shares = learning.principal(df, ["a", "b"], 0.99)
    assert mean == pytest.approx(pts.mean(0)) and shares.sum() == pytest.approx(1)
    q = df.select(*(c.alias(f"c{i}") for i, c in enumerate(learning.projected(["a", "b"], mean, vectors)))).toPandas()
    assert q.var(ddof=0).to_numpy() == pytest.approx((np.linalg.eigvalsh(np.cov(pts.T, bias=True))[::-1])[: len(vectors)])
    k = {r.k: r.bic for r in learning.bic_sweep(df, ["a", "b"], 2).collect()}
    assert k[2] < k[1]  # two clouds


def test_importance(spark):
    _, df = cloud(spark)
    got = {r.feature: r["drop"] for r in learning.permutation_importance(df, ["a", "b"], -F.abs("a"), "id").collect()}
    assert got["b"] == 0 and abs(got["a"]) < 1


def test_neighbours_and_lonely_points(spark):
    r = np.random.default_rng(9)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(r.uniform(0, 10, (60, 2)))] + [(60, 300.0, 300.0)]
    got = {}
    for row in spatial.neighbour_graph(spark.createDataFrame(pts, "id long, x double, y double"), "id", 3, 1.0).collect():
        got.setdefault(row.id, {})[row["rank"]] = row.other
    for i, x, y in pts:
        near = sorted(((p[1] - x) ** 2 + (p[2] - y) ** 2, p[0]) for p in pts if p[0] != i)[:3]
        assert [got[i][k] for k in (1, 2, 3)] == [p[1] for p in near]


def test_names(spark):
    df = spark.createDataFrame([("F_small_obb_tile_1_2_x.rf.a.jpg",), ("plain.txt",), (None,)], "name string")
    assert [r.n for r in df.select(labels.field_name(F.col("name")).alias("n")).collect()] == ["F_small_tile_1_2.jpg", "plain.txt", None]
    with pytest.raises(ValueError):
        labels.combined({})


def test_running_sums_in_parts(spark):
    import random

    from agrispark.operators.ranges import running_sums

    rng = random.Random(3)
    values = sorted({rng.choice((0.5, 1e3, -7.0)) * rng.random() for _ in range(700)})
    df = spark.createDataFrame([(v, i % 5) for i, v in enumerate(values)], "v double, n long").repartition(5)
    total, want = 0, {}
    for i, v in enumerate(values):
        want[v] = (total, total := total + i % 5)
    up = running_sums(running_sums(df, "v", {"upto": "n"}), "v", {"before": "n"}, inclusive=False)
    assert {r.v: (r.before, r.upto) for r in up.collect()} == want
    down = {r.v: r.s for r in running_sums(df, "v", {"s": "n"}, descending=True).collect()}
    assert down == {v: total - b for v, (b, _) in want.items()}
    assert running_sums(df.limit(0), "v", {"s": "n"}).count() == 0


def test_unknown_indices_are_an_error():
    import pytest

    from agrispark.functions import spectral

    assert spectral.configured(" ndvi,, Rvi") == ["NDVI", "RVI"]
    with pytest.raises(ValueError, match="NOPE"):
        spectral.configured("NDVI, nope")


def test_route_file_holds_the_route(spark):
    import oracle
    from agrispark.operators import models
    from agrispark.plans import registry
    from agrispark.plans.fixtures import view

    sf = f"{oracle.DATA}/sf0.001"
    route = models.zone_routes(view(spark, sf, "v_points"))
    got = sorted((r.sequence, r.orig_fid, r.x, r.y) for r in registry.QUERIES["s8_route_csv"](spark, sf).collect())
    assert got == sorted((r.seq, r.fid, r.x, r.y) for r in route.collect())


def test_order_crossover_and_turning():
    import numpy as np

    from agrispark.operators.models import crossed, turned

    rng = np.random.default_rng(2)
    mothers, fathers = (np.array([rng.permutation(9) for _ in range(200)]) for _ in range(2))
    lo, hi = np.sort(rng.integers(0, 10, (2, 200)), axis=0)
    for child, mother, father, a, b in zip(crossed(mothers, fathers, lo, hi), mothers, fathers, lo, hi, strict=True):
        want = mother.copy()
        rest = [s for s in [*father[b:], *father[:b]] if s not in set(mother[a:b])]
        for place, stop in zip([*range(b, 9), *range(a)], rest, strict=True):
            want[place] = stop
        assert (child == want).all()
    for new, old, a, b in zip(turned(mothers, lo, hi), mothers, lo, hi, strict=True):
        assert (new == np.concatenate([old[:a], old[a:b][::-1], old[b:]])).all()


def test_vocabulary_finds_the_middles_of_clusters(spark):
    import numpy as np

    from agrispark.operators import learning

    rng = np.random.default_rng(6)
    centres = np.array([[0.0, 0.0, 9.0], [9.0, 0.0, 0.0], [0.0, 9.0, 0.0], [5.0, 5.0, 5.0]])
    points = np.concatenate([c + rng.normal(scale=0.1, size=(50, 3)) for c in centres])
    d = spark.createDataFrame([(i, i // 10, v.tolist()) for i, v in enumerate(points)], "desc_id long, image_id long, vec array<double>")
    words = learning.vocabulary(d, 4)
    order = [int(((words - c) ** 2).sum(axis=1).argmin()) for c in centres]
    assert sorted(order) == [0, 1, 2, 3]
    assert np.allclose(words[order], points.reshape(4, 50, 3).mean(axis=1))
    named = {r.desc_id: r.w for r in d.select("desc_id", learning.nearest_word(d.vec, words).alias("w")).collect()}
    assert all(named[i] == order[i // 50] for i in range(200))


def grown_by_grid(rows, least):
    """Groups grown in order, with areas counted in cells of 1/64 (bounds are multiples of it)."""
    cells = [{(x, y) for x in range(int(r[3] * 64), int(r[5] * 64)) for y in range(int(r[4] * 64), int(r[6] * 64))} for r in rows]
    left, out = list(range(len(rows))), {}
    while left:
        first, members, union = left[0], [left[0]], set(cells[left.pop(0)])
        grew = True
        while grew:
            grew = False
            lo, hi = [min(rows[m][i] for m in members) for i in (3, 4)], [max(rows[m][i] for m in members) for i in (5, 6)]
            for k in [k for k in left if rows[k][3] <= hi[0] and rows[k][5] >= lo[0] and rows[k][4] <= hi[1] and rows[k][6] >= lo[1]]:
                if len(cells[k] & union) >= least * min(len(cells[k]), len(union)):
                    union |= cells[k]
                    members.append(k)
                    left.remove(k)
                    grew = True
        for m in members:
            out[rows[m][0]] = rows[first][0]
    return out


def test_groups_grown_in_order(spark):
    r = np.random.default_rng(12)
    rows = []
    for i in range(70):
        x, y = r.integers(0, 160, 2) / 64
        w, h = r.integers(8, 48, 2) / 64
        rows.append((100 - i, int(r.integers(0, 2)), float(r.uniform()), float(x), float(y), float(x + w), float(y + h)))
    df = spark.createDataFrame(rows, BOXES)
    differ = False
    for least in (0.1, 0.4, 1.0):
        want = grown_by_grid(sorted(rows), least)
        got = {g.group_id: g for g in spatial.merge_greedy(df, "pred_id", least, 0.5, "avg").collect()}
        assert {k: g.n for k, g in got.items()} == {k: list(want.values()).count(k) for k in set(want.values())}
        for k, g in got.items():
            own = [x for x in rows if want[x[0]] == k]
            assert (g.minx, g.maxy, g.class_id) == (min(x[3] for x in own), max(x[6] for x in own), next(x[1] for x in own if x[0] == k))
            assert g.conf == pytest.approx(np.mean([x[2] for x in own]))
        differ |= len(got) != spatial.merge_boxes(df, "pred_id", least, 0.5).count()
    assert differ  # the order counts
    assert spatial.merge_greedy(df.limit(0), "pred_id").count() == 0
    with pytest.raises(ValueError):
        spatial.merge_greedy(df, "pred_id", 0.0)


def test_mean_distances(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(50, 6)) + 1000
    x[7] = x[3] + 1e-7
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(x)] + [(99, None)]
    df = spark.createDataFrame(rows, "desc_id long, vec array<double>")
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2)).sum(1) / 49
    for block in (7, 1000):
        got = {a.desc_id: a.mean_dist for a in models.mean_distance(df, block).collect()}
        assert sorted(got) == list(range(50)) and np.allclose([got[i] for i in range(50)], d, rtol=1e-9)
    assert models.mean_distance(df.limit(1)).first().mean_dist is None
    assert models.mean_distance(df.limit(0)).count() == 0
    far = models.outliers(df, float(np.sort(d)[-3]), "euclidean")
    assert {a.desc_id for a in far.collect()} == set(np.argsort(d)[-2:].tolist())
    plan = models.mean_distance(df, 7)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_blocks_of_mean_distances_grow_with_the_table(spark):
    """A row travels as often in a larger table, so that the shuffle follows the rows."""
    for n in (60, 240):
        df = spark.range(n).selectExpr("id AS desc_id", "array(double(id), 0.0D) AS vec")
        found = models.mean_distance(df, block=5, dealt=4)
        assert "sequence(0, 3," in found._jdf.queryExecution().analyzed().toString()
        want = [sum(abs(i - j) for j in range(n)) / (n - 1) for i in range(n)]
        got = {r.desc_id: r.mean_dist for r in found.collect()}
        assert [got[i] for i in range(n)] == pytest.approx(want)
    many = models.mean_distance(df, block=5, most=30, dealt=4)  # blocks of bounded size beyond that
    assert "sequence(0, 7," in many._jdf.queryExecution().analyzed().toString()


def test_stitched_routes_take_the_shortest_links(spark):
    from itertools import product

    r = np.random.default_rng(9)
    zones = {z: r.uniform(0, 10, (int(r.integers(1, 6)), 2)) + [12 * (z % 3), 12 * (z // 3)] for z in range(6)}
    rows = [(z, i, 100 * z + i, float(x), float(y)) for z, p in zones.items() for i, (x, y) in enumerate(p)]
    df = spark.createDataFrame(rows, "zone int, seq long, fid long, x double, y double")
    got = models.stitched(df, 12.0).orderBy("seq").collect()
    assert [g.seq for g in got] == list(range(len(rows)))
    order = list(dict.fromkeys(g.zone for g in got))
    middle = {z: (p.min(0) + p.max(0)) / 2 for z, p in zones.items()}
    line = lambda z: int((middle[z][1] - min(m[1] for m in middle.values())) // 12)
    assert order == sorted(zones, key=lambda z: (line(z), middle[z][0] * (1 - 2 * (line(z) % 2))))
    links = lambda ways: sum(np.hypot(*(zones[b][::s2][0] - zones[a][::s1][-1])) for (a, s1), (b, s2) in zip(ways, ways[1:], strict=False))
    best = min(links(list(zip(order, s, strict=True))) for s in product((1, -1), repeat=6))
    inside = sum(np.hypot(*np.diff(p, axis=0).T).sum() for p in zones.values())
    total = models.route_line(models.stitched(df, 12.0)).first()
    assert (total.n_points, total.length) == (len(rows), pytest.approx(inside + best))
    assert models.stitched(df.limit(0), 12.0).count() == 0 and models.route_line(df.limit(0)).first().length == 0


def test_ranks_from_range_parts(spark):
    r = np.random.default_rng(4)
    rows = [(int(z), i, float(x)) for i, (z, x) in enumerate(zip(r.integers(0, 3, 500), r.integers(0, 90, 500), strict=True))]
    got = {g.fid: g._rank for g in models.ranked(spark.createDataFrame(rows, "zone int, fid long, x double"), "zone", "x", "fid", 40).collect()}
    for z in range(3):
        own = sorted((x, f) for q, f, x in rows if q == z)
        assert [got[f] for _, f in own] == list(range(len(own)))


def test_exact_percentiles(spark):
    r = np.random.default_rng(7)
    for values in (r.normal(size=3000), np.round(r.exponential(size=2000), 1), np.full(50, 3.5), np.array([1.0]), np.concatenate([10.0 ** r.uniform(-300, 300, 900), -(10.0 ** r.uniform(-9, 300, 900))]), np.array([0.0, 5e-324, 1e-320, 1.7e308, -1.7e308])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
        shares = [0.0, 0.001, 0.25, 0.5, 0.975, 1.0]
        with np.errstate(over="ignore"):
            low, high = (np.quantile(values, shares, method=m) for m in ("lower", "higher"))
        at = (len(values) - 1) * np.array(shares)
        for few in (10, 10_000):
            got = np.array(ranges.exact_percentiles(df, "v", shares, 16, few))
            assert np.allclose(got, low + (high - low) * (at % 1), rtol=1e-12, atol=0) or np.isinf(high - low).any()
            assert got[0] == values.min() and got[-1] == values.max()
    assert ranges.exact_percentiles(df.limit(0), "v", [0.5]) == [None]
    infinite = spark.createDataFrame([(float(v),) for v in (-np.inf, 1, 2, 3, np.inf)], "v double")
    assert ranges.exact_percentiles(infinite, "v", [0.0, 0.5, 1.0], 4, 0) == [-np.inf, 2.0, np.inf]


def test_exact_one_class_machine():
    r = np.random.default_rng(3)
    x = r.normal(size=(200, 3))
    kernel = learning.radial(x, x, 0.4)
    assert np.allclose(kernel, [[np.exp(-0.4 * ((a - b) ** 2).sum()) for b in x] for a in x])
    for nu in (0.001, 0.1, 0.5):
        w, rho = learning.one_class_dual(kernel, nu)
        assert w.min() >= 0 and w.max() <= 1 and w.sum() == pytest.approx(nu * 200)
        out = kernel @ w
        assert (out[w <= 0] >= rho - 1e-5).all() and (out[w >= 1] <= rho + 1e-5).all()
        # another solver: projected gradient steps on the same problem
        p = np.full(200, nu)
        for _ in range(6000):
            p = p - 0.02 * kernel @ p
            lo, hi = p.min() - 1, p.max()
            for _ in range(60):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if np.clip(p - mid, 0, 1).sum() > nu * 200 else (lo, mid)
            p = np.clip(p - hi, 0, 1)
        assert w @ kernel @ w <= p @ kernel @ p + 1e-4 * (1 + p @ kernel @ p)


def test_exact_machine_and_forest_as_detectors(spark):
    r = np.random.default_rng(2)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(r.normal(size=(600, 2)))] + [(1000, 40.0, -40.0), (1001, None, 1.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    inner = df.where("id < 1000")
    for detector, cut in ((detectors.ExactOneClass(["a", "b"], "id", 0.05, 300), 0.0), (detectors.Forest(["a", "b"], "id", 50), None)):
        fitted = detector.fit(inner)
        cut = detectors.cut_at(fitted, inner, 0.05) if cut is None else cut
        got = {x.id: x.score for x in fitted.score(df).collect()}
        assert got[1001] is None and got[1000] < cut and len(got) == 602
        share = np.mean([v < cut for k, v in got.items() if k < 1000])
        assert 0.02 < share < 0.09
    with pytest.raises(ValueError):
        detectors.ExactOneClass(["a", "b"], "id").fit(df.limit(0))


def test_band_numbers_of_existing_stacks():
    from agrispark.functions import spectral

    assert spectral.band_refs(["NDVI", "SVI", "NGRDI", "VEG", "RED", "NIR", 3]) == [8, 9, 10, 39, 1, 7, 3]
    assert sorted(spectral.STACK_INDICES) == sorted(n for n in spectral.FORMULAS if n in spectral.STACK_INDICES) and len(spectral.STACK_INDICES) == 32
    with pytest.raises(ValueError):
        spectral.band_refs(["NDVX"])


def test_fusion_run_on_one_field(spark):
    boxes_of = lambda rows, kind: spark.createDataFrame(rows, kind + ", minx double, miny double, maxx double, maxy double")
    at = lambda x, y=0.0: (x, y, x + 1.0, y + 1.0)
    truths = boxes_of([(1, *at(0.0)), (2, *at(10.0)), (3, *at(20.0))], "gt_id long")
    first = boxes_of([(1, 0.9, *at(0.1)), (2, 0.2, *at(50.0)), (3, 0.3, *at(50.5))], "pred_id long, conf double")
    second = boxes_of([(7, 5.0, *at(0.0)), (8, 4.0, *at(10.0)), (9, 0.0, *at(70.0))], "svm_id long, margin double")
    run = fusion.fusion_run(first, second, truths, 0.5)
    assert {r.layer: (r.tp, r.fp, r.fn) for r in run.counts.collect()} == {"first": (1, 2, 2), "second": (2, 1, 1), "fused": (1, 1, 2)}
    layer = {r.minx: r for r in run.layer.collect()}
    assert (layer[0.0].n, layer[0.0].source, layer[0.0].result, layer[50.0].n, layer[50.0].conf, layer[50.0].result) == (2, "both", "TP", 2, 0.3, "TN")
    total = fusion.fusion_report({"a": run, "b": run}).where("field = 'all' and layer = 'second'").first()
    assert (total.tp, total.fp, total.fn, total.precision) == (4, 2, 2, 0.6667)
    none = fusion.fusion_run(first.limit(0), second.limit(0), truths, 0.5)
    assert none.threshold is None and none.layer.count() == 0


def test_scree_of_four_bands(spark):
    r = np.random.default_rng(11)
    x = r.normal(size=(300, 4)) @ r.normal(size=(4, 4)) + 5
    df = spark.createDataFrame([tuple(map(float, v)) for v in x], "a double, b double, c double, d double")
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    got = learning.scree(df, list("abcd")).orderBy("component").collect()
    share = values[::-1] / values.sum()
    assert np.allclose([g.share for g in got], share) and np.allclose([g.cumulative for g in got], np.cumsum(share))
    assert [g.top for g in got] == ["abcd"[int(np.abs(vectors[:, k]).argmax())] for k in (3, 2, 1, 0)]


def test_more_nu_accepts_less(spark):
    r = np.random.default_rng(13)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(r.normal(size=(400, 2)))], "id long, a double, b double")
    share = []
    for nu in (0.01, 0.1, 0.3, 0.6):
        out = learning.one_class_exact_scores(df, ["a", "b"], "id", learning.fit_one_class_exact(df, ["a", "b"], "id", nu, 400))
        share.append(np.mean([x.score >= -1e-9 for x in out.collect()]))
    assert share == sorted(share, reverse=True) and all(abs(1 - s - nu) < 0.03 for s, nu in zip(share, (0.01, 0.1, 0.3, 0.6), strict=True))


def test_neighbours_of_far_points(spark):
    pts = [(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 1e7, 0.0), (3, -1e7, 3e6), (4, 0.0, 0.0), (5, None, 1.0)]
    got = {}
    for g in spatial.neighbour_graph(spark.createDataFrame(pts, "id int, x double, y double"), "id", 2, 1.0).collect():
        got.setdefault(g.id, {})[g["rank"]] = g.other
    for i, x, y in pts[:5]:
        near = sorted((np.hypot(x - a, y - b), j) for j, a, b in pts[:5] if j != i)
        assert [got[i][1], got[i][2]] == [j for _, j in near[:2]]

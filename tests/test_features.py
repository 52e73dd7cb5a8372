"""Textures, patterns, scored layers and genetic routes against brute force, known values and invariants."""

import math
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

import oracle
from agrispark.operators import detectors, features, models
from agrispark.plans import registry

RING = "obj long, ring array<struct<x: double, y: double>>"
PIXELS = "x int, y int, nir double, red double"


def square(x, y, size):
    return [(x, y), (x + size, y), (x + size, y + size), (x, y + size)]


def raster(spark, side=24, seed=1):
    r = np.random.default_rng(seed)
    v = r.integers(0, 1000, (side, side)).astype(float)
    return v, spark.createDataFrame([(x, y, float(v[y, x]), 5.0) for y in range(side) for x in range(side)], PIXELS)


def pattern(v, y, x):
    """The code of one pixel, from real-valued interpolation."""
    at = lambda j, i: v[j, i] if 0 <= j < v.shape[0] and 0 <= i < v.shape[1] else 0
    bits = []
    for k in range(8):
        px, py = x + round(3 * math.cos(2 * math.pi * k / 8), 5), y - round(3 * math.sin(2 * math.pi * k / 8), 5)
        i, j = math.floor(px), math.floor(py)
        fx, fy = px - i, py - j
        got = (at(j, i) * (1 - fx) + at(j, i + 1) * fx) * (1 - fy) + (at(j + 1, i) * (1 - fx) + at(j + 1, i + 1) * fx) * fy
        bits.append(got >= v[y, x] - 1e-6)
    return sum(bits) if sum(a != b for a, b in zip(bits, bits[1:])) <= 2 else 9


def test_patterns(spark):
    v = np.random.default_rng(3).integers(0, 256, (9, 11))
    v[:3, :4] = 7  # ties
    rows = [(1, x, y, int(v[y, x])) for y in range(9) for x in range(11)]
    df = spark.createDataFrame(rows, "obj long, x int, y int, v int")
    got = {(r.y, r.x): r.code for r in features.local_patterns(df).collect()}
    assert got == {(y, x): pattern(v, y, x) for y in range(9) for x in range(11)}
    p = np.bincount(list(got.values()), minlength=10) / len(got)
    mean = (p * np.arange(10)).sum()
    stats = features.pattern_stats(features.local_patterns(df)).first()
    assert stats[1:] == pytest.approx([mean, (p * (np.arange(10) - mean) ** 2).sum(), (p * p).sum(), -sum(q * math.log2(q) for q in p if q)])
    assert features.pattern_stats(features.local_patterns(df.limit(0))).count() == 0


def test_vectors_of_odd_polygons(spark):
    v, px = raster(spark)
    rings = [(1, square(2.0, 2.0, 8.0)), (2, square(1.0, 1.0, 2.0)), (3, None), (4, [(0.0, 0.0), (1.0, 1.0)]), (5, square(20.0, 20.0, 9.0)), (6, square(90.0, 90.0, 9.0))]
    got = features.feature_matrix([(spark.createDataFrame(rings, RING), px)], ["nir", "red"], F.col("nir") > 300).collect()
    assert sorted(r.obj for r in got) == [1, 5]  # too small, null, no polygon, off the raster; 5 reaches over its edge
    one = next(r for r in got if r.obj == 1)
    assert all(one[f"red_{p}"] == 0 for p in features.PROPS)  # a flat column
    win = v[2:10, 2:10]
    q = np.where(win > 300, np.rint((win - win.min()) / (win.max() - win.min()) * 255), 0)
    ys, xs = np.nonzero(win > 300)
    q = q[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1]
    pairs = [(q[:, :-1], q[:, 1:]), (q[1:, :-1], q[:-1, 1:]), (q[:-1], q[1:]), (q[:-1, :-1], q[1:, 1:])]
    assert one.nir_contrast == pytest.approx(np.mean([((a - b) ** 2).mean() for a, b in pairs]))
    assert one.nir_mean == pytest.approx(np.mean([(a.mean() + b.mean()) / 2 for a, b in pairs]))
    none = features.feature_matrix([(spark.createDataFrame(rings, RING), px)], ["nir"], F.col("nir") > 5000)
    assert none.count() == 0  # nothing marked


def test_sampled_fields_are_stacked(spark):
    _, px = raster(spark, 40)
    rings = spark.createDataFrame([(i, square(float(i % 8) * 4, float(i // 8) * 4, 4.0)) for i in range(64)], RING)
    some = features.feature_matrix([(rings, px), (rings, px)], ["nir"], F.lit(True), share=0.5).select("field", "obj").collect()
    first = {r.obj for r in some if r.field == 0}
    assert 15 < len(first) < 50 and first == {r.obj for r in some if r.field == 1}


def test_layer_scores(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(60, 4)) @ r.normal(size=(4, 4))
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "obj long, a double, b double, c double, d double")
    model = detectors.Distance(list("abcd"), 0.9).fit(df)
    z = (x - x.mean(0)) / x.std(0)
    values, vectors = np.linalg.eigh(np.cov(z.T, bias=True))
    share = np.cumsum(values[::-1]) / values.sum()
    kept = max(2, int(np.searchsorted(share, 0.9)) + 1)
    t = z @ vectors[:, ::-1][:, :kept]
    s = t.T @ t / len(t)
    mu = np.trace(s) / kept
    delta = ((s - mu * np.eye(kept)) ** 2).sum()
    beta = min(sum(((np.outer(u, u) - s) ** 2).sum() for u in t) / len(t) ** 2, delta)
    shrunk = (1 - beta / delta) * s + beta / delta * mu * np.eye(kept)
    want = np.sqrt(np.einsum("ij,jk,ik->i", t, np.linalg.inv(shrunk), t))
    got = {row.obj: -row.score for row in model.score(df).collect()}
    assert [got[i] for i in range(60)] == pytest.approx(want.tolist())
    assert model.support == 60
    layer = spark.createDataFrame([(i, "n") for i in range(62)], "obj long, note string")
    cut = detectors.cut_at(model, df, 0.1)
    out = {row.obj: row for row in detectors.score_layer(layer, df, model, cut).collect()}
    assert len(out) == 62 and out[61].score is None and out[61].is_inlier is None
    assert sum(bool(row.is_inlier) for row in out.values()) == 54
    with pytest.raises(ValueError):
        detectors.Distance(["a"]).fit(df.limit(0))


def test_all_detectors_tell_far_rows(spark):
    r = np.random.default_rng(6)
    rows = [(i, *map(float, r.normal(0, 1, 2))) for i in range(300)] + [(1000, 30.0, -30.0)]
    df = spark.createDataFrame(rows, "obj long, a double, b double")
    near = df.where("obj < 1000")
    for kind in (detectors.Distance(["a", "b"]), detectors.Mixture(["a", "b"], 2), detectors.OneClass(["a", "b"])):
        model = kind.fit(near)
        cut = detectors.cut_at(model, near, 0.02)
        assert not model.score(df).where(f"obj = 1000 AND score >= {cut}").count(), kind


def test_genetic_routes(spark):
    r = np.random.default_rng(7)
    pts = [(z, 100 * z + i, float(x), float(y)) for z in range(2) for i, (x, y) in enumerate(r.uniform(0, 10, (7, 2)))] + [(8, 800 + i, float(i % 3), float(i // 3)) for i in range(9)]
    pts += [(8, 900, 0.0, 0.0), (9, 990, 0.0, 0.0), (9, 991, 1.0, 1.0)]  # a repeated place; a zone under 3 points
    df = spark.createDataFrame(pts, "zone int, fid long, x double, y double")
    route = models.genetic_routes(df, islands=2, rounds=20)
    rows = route.collect()
    assert sorted(x.fid for x in rows) == sorted(p[1] for p in pts if p[0] != 9)
    assert sorted((x.zone, x.seq, x.fid) for x in rows) == sorted((x.zone, x.seq, x.fid) for x in models.genetic_routes(df, islands=2, rounds=20).collect())
    for z, length in ((x.zone, x.length) for x in models.route_length(route).collect()):
        at = np.array([p[2:] for p in pts if p[0] == z])
        if z < 2:
            assert length == pytest.approx(min(np.hypot(*np.diff(at[list(o)], axis=0).T).sum() for o in permutations(range(7))))
        else:
            assert length == pytest.approx(8.0)
    cut = models.genetic_routes(df, islands=1, size=12, rounds=2, most=4).collect()
    assert sorted(x.fid for x in cut) == sorted(x.fid for x in rows)
    near = models.zone_routes(df, near=3).collect()
    assert sorted(x.fid for x in near) == sorted(x.fid for x in rows)
    assert models.genetic_routes(df.limit(0)).count() == 0


def test_queries_are_not_empty(spark):
    for name in ("f5_f7_feature_matrix", "f4_binary_patterns", "x1_tile_callback", "r5_genetic_routes"):
        assert registry.QUERIES[name](spark, f"{oracle.DATA}/sf0.001").count() > 0, name

"""Every field-survey query against DuckDB, and what SQL can't express against invariants."""

import math

import pytest

import oracle
from agrispark.operators import models, normalize, segments, spatial
from agrispark.operators.components import connected_components
from agrispark.plans import registry

SF = f"{oracle.DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, con, name):
    assert oracle.same(registry.QUERIES[name](spark, SF), con, registry.ORACLE_SQL[name]) == ""


def test_flagship(spark):
    assert registry.flagship(spark, SF).count() > 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (5, 5), (None, 4), (3, 1), (3, 1)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_diagonal_pixels_are_one_segment(spark):
    px = [(0, 0, 0, 0, 0), (0, 0, 1, 1, 1), (0, 0, 5, 5, 2)]
    got = segments.segments(spark.createDataFrame(px, "tile_row int, tile_col int, x int, y int, pix_id long")).collect()
    assert sorted((r.x, r.y, r.w, r.h, r.n_px) for r in got) == [(0, 0, 2, 2, 2), (5, 5, 1, 1, 1)]


def test_routes_visit_every_point_once(spark):
    pts = [(z, 100 * z + i, math.sin(i * 12.9) * 10, math.cos(i * 78.2) * 10) for z in range(3) for i in range(40)] + [(9, 900, 0.0, 0.0), (9, 901, 1.0, 1.0)]
    df = spark.createDataFrame(pts, "zone int, fid long, x double, y double")
    route = models.zone_routes(df)
    rows = route.collect()
    assert sorted(r.fid for r in rows) == sorted(p[1] for p in pts if p[0] != 9)  # under 3 points: no route
    by = {r.zone: r.length for r in models.route_length(route).collect()}
    raw = {r.zone: r.length for r in models.route_length(df.withColumn("seq", df.fid)).collect()}
    assert all(by[z] < raw[z] for z in by)


def test_touching_and_empty_boxes(spark):
    kind = "pred_id long, class_id int, conf double, minx double, miny double, maxx double, maxy double"
    a = spark.createDataFrame([(1, 0, 0.5, 0.0, 0.0, 1.0, 1.0), (2, 0, 0.7, 1.0, 0.0, 2.0, 1.0), (3, 0, 0.9, 5.0, 5.0, 5.0, 5.0)], kind)
    pairs = spatial.box_pairs(a, a).where("pred_id < b_pred_id").select("pred_id", "b_pred_id", spatial.iou().alias("iou")).collect()
    assert [tuple(r) for r in pairs] == [(1, 2, 0.0)]
    assert spatial.merge_boxes(a, "pred_id").count() == 3
    assert spatial.merge_boxes(a.limit(0), "pred_id").count() == 0


def test_flat_tile_is_zero(spark):
    px = spark.createDataFrame([(0, 0, 7), (0, 0, 7)], "tile_row int, tile_col int, v int")
    assert [r.o for r in normalize.minmax_tile(px, "v", "o").collect()] == [0, 0]


def test_no_nested_loop_in_box_joins(spark):
    plan = registry.QUERIES["j1_j2_overlaps"](spark, SF)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan

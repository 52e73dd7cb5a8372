"""Queries on polygons, matching, layers of detections, fusion and evaluation."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from agrispark.functions import geometry as P
from agrispark.operators import contours as O, coverage as C, fusion as U, labels as L, matching as A, polygons as Q, segments as G, spatial as J
from agrispark.plans.fixtures import view
from agrispark.plans.register import ORACLE_SQL, half_up, query
from agrispark.plans.registry import _BEST, _BOUNDS, _SEGS, _TRUTH, IOU, RATIO, _scored, a2_a3_confusion, mask_pixels
from agrispark.session import stored

BOX = ["minx", "miny", "maxx", "maxy"]


def _pair(spark, sf):
    return view(spark, sf, "v_pred"), view(spark, sf, "v_gt")


@query("j3_iou", f"SELECT a.pred_id, b.gt_id, round({IOU}, 6) AS iou FROM v_pred a JOIN v_gt b ON {IOU} >= 0.1")
def j3_iou(spark, sf):
    pairs = J.box_pairs(*_pair(spark, sf)).select("pred_id", F.col("b_gt_id").alias("gt_id"), J.iou().alias("iou"))
    return pairs.where("iou >= 0.1").withColumn("iou", F.round("iou", 6))


@query("j4_quad_iou", f"SELECT a.pred_id, b.gt_id, round({IOU}, 6) AS iou FROM v_pred a JOIN v_gt b ON {IOU} > 0.001")
def j4_quad_iou(spark, sf):
    """Overlap doesn't change when both layers are turned and stretched by the whole numbers 3 and 4 (53 degrees, 5 times), which SQL on the boxes checks."""

    def ring(pre: str):
        return F.array(*(F.struct((F.col(pre + x) * 3 - F.col(pre + y) * 4).alias("x"), (F.col(pre + x) * 4 + F.col(pre + y) * 3).alias("y")) for x, y in (("minx", "miny"), ("minx", "maxy"), ("maxx", "maxy"), ("maxx", "miny"))))

    pairs = J.box_pairs(*_pair(spark, sf)).select("pred_id", F.col("b_gt_id").alias("gt_id"), ring("").alias("a"), ring("b_").alias("b"))
    return pairs.select("pred_id", "gt_id", Q.quad_iou(F.col("a"), F.col("b")).alias("iou")).where("iou > 0.001").withColumn("iou", half_up("iou", 6))


# a prediction of the views meets the truth of its own cell alone, so the best assignment is each truth's best prediction
_ONE = "(SELECT arg_max(pred_id, (iou, -pred_id)) AS pred_id, gt_id, max(iou) AS iou FROM (SELECT a.pred_id, a.conf, b.gt_id, {iou} AS iou FROM {pred} a JOIN v_gt b ON a.class_id = b.class_id AND {iou} > 0) p GROUP BY gt_id HAVING max(iou) >= 0.5)"


@query("j6_one_to_one", f"SELECT pred_id, gt_id, round(iou, 6) AS iou FROM {_ONE.format(iou=IOU, pred='v_pred')} m")
def j6_one_to_one(spark, sf):
    return A.one_to_one(*_pair(spark, sf)).withColumn("iou", F.round("iou", 6))


def _image_units(df):
    """Boxes in units of their own image, which is their tile: equal coordinates come back in every image. Dividing by 16 keeps them exact."""
    inside = lambda c, tile: (F.col(c) - F.col(tile) * 10) / 16
    return df.withColumns({"minx": inside("minx", "tile_col"), "maxx": inside("maxx", "tile_col"), "miny": inside("miny", "tile_row"), "maxy": inside("maxy", "tile_row")})


IMAGE = ["tile_row", "tile_col"]


@query("j6_image_matching", f"SELECT p.tile_row, p.tile_col, m.pred_id, m.gt_id, round(m.iou, 6) AS iou FROM {_ONE.format(iou=IOU, pred='v_pred')} m JOIN v_pred p ON p.pred_id = m.pred_id")
def j6_image_matching(spark, sf):
    """Labels of many images in units of the image, matched image by image."""
    pred, gt = map(_image_units, _pair(spark, sf))
    return A.one_to_one(pred, gt, size=0.125, on=IMAGE).withColumn("iou", F.round("iou", 6))


_GAP = "greatest(" + ", ".join(f"power(greatest(b.minx - a.{x}, a.{x} - b.maxx, 0), 2) + power(greatest(b.miny - a.{y}, a.{y} - b.maxy, 0), 2)" for x in ("minx", "maxx") for y in ("miny", "maxy")) + ")"


@query("j8_within_buffer", f"SELECT p.pred_id, CASE WHEN m.pred_id IS NULL THEN 0 ELSE 1 END AS inside FROM v_pred p LEFT JOIN (SELECT DISTINCT a.pred_id FROM v_pred a JOIN v_gt b ON {_GAP} <= 0.0625) m ON m.pred_id = p.pred_id")
def j8_within_buffer(spark, sf):
    return J.within_buffer(*_pair(spark, sf), 0.25, "pred_id")


# Along x, the outlines of grown truths and a box change their order only at these places; between two of them one upright line tells.
_UNION = """WITH near AS (SELECT a.pred_id, a.minx AS x0, a.miny AS y0, a.maxx AS x1, a.maxy AS y1, b.minx, b.miny, b.maxx, b.maxy FROM v_pred a JOIN v_gt b
  ON b.minx - r.b <= a.maxx AND a.minx <= b.maxx + r.b AND b.miny - r.b <= a.maxy AND a.miny <= b.maxy + r.b),
 corner AS (SELECT DISTINCT pred_id, x0, y0, x1, y1, unnest([minx, minx, maxx, maxx]) AS x, unnest([miny, maxy, miny, maxy]) AS y FROM near),
 level AS (SELECT DISTINCT pred_id, unnest([miny - r.b, maxy + r.b, y0, y1]) AS y FROM near),
 place AS (SELECT pred_id, unnest([x0, x1, minx - r.b, minx, maxx, maxx + r.b]) AS x FROM near
  UNION SELECT c.pred_id, unnest([c.x - sqrt(power(r.b, 2) - power(l.y - c.y, 2)), c.x + sqrt(power(r.b, 2) - power(l.y - c.y, 2))]) FROM corner c JOIN level l ON l.pred_id = c.pred_id AND abs(l.y - c.y) <= r.b
  UNION SELECT pred_id, unnest([mx - side, mx + side]) FROM (SELECT c.pred_id, (c.x + d.x) / 2 AS mx, sqrt(greatest(power(r.b, 2) - power(sqrt(power(c.x - d.x, 2) + power(c.y - d.y, 2)), 2) / 4, 0)) * (d.y - c.y) / sqrt(power(c.x - d.x, 2) + power(c.y - d.y, 2)) AS side
   FROM corner c JOIN corner d ON d.pred_id = c.pred_id AND (d.x, d.y) > (c.x, c.y) AND sqrt(power(c.x - d.x, 2) + power(c.y - d.y, 2)) <= 2 * r.b) m),
 edge AS (SELECT DISTINCT p.pred_id, y0, y1, least(greatest(p.x, x0), x1) AS x FROM place p JOIN (SELECT DISTINCT pred_id, x0, y0, x1, y1 FROM near) n ON n.pred_id = p.pred_id),
 line AS (SELECT * FROM (SELECT pred_id, y0, y1, (x + lead(x) OVER (PARTITION BY pred_id ORDER BY x)) / 2 AS x FROM edge) e WHERE x IS NOT NULL),
 span AS (SELECT l.pred_id, l.x, l.y0, l.y1, n.miny - sqrt(power(r.b, 2) - power(greatest(n.minx - l.x, l.x - n.maxx, 0), 2)) AS lo, n.maxy + sqrt(power(r.b, 2) - power(greatest(n.minx - l.x, l.x - n.maxx, 0), 2)) AS hi
  FROM line l JOIN near n ON n.pred_id = l.pred_id AND greatest(n.minx - l.x, l.x - n.maxx, 0) <= r.b),
 walk AS (SELECT *, greatest(y0, coalesce(max(hi) OVER (PARTITION BY pred_id, x ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), y0)) AS reach FROM span),
 whole AS (SELECT pred_id, x, bool_and(lo <= reach + 1e-12 OR reach >= y1 - 1e-12) AND max(hi) >= y1 - 1e-12 AS ok FROM walk GROUP BY pred_id, x, y1),
 got AS (SELECT l.pred_id, bool_and(coalesce(ok, false)) AS ok FROM line l LEFT JOIN whole w ON w.pred_id = l.pred_id AND w.x = l.x GROUP BY l.pred_id)
 SELECT p.pred_id, CASE WHEN ok THEN 1 ELSE 0 END AS inside FROM v_pred p LEFT JOIN got g ON g.pred_id = p.pred_id""".replace("r.b", "0.25::DOUBLE")


@query("j8_within_union", _UNION)
def j8_within_union(spark, sf):
    """As j8_within_buffer, of all truths together."""
    return C.within_union(*_pair(spark, sf), 0.25, "pred_id")


@query("j10_merge_rectangles")
def j10_merge_rectangles(spark, sf):
    return Q.merge_to_rectangles(view(spark, sf, "v_pred"), "pred_id", 0.4)


@query("j11_merge_union", """WITH RECURSIVE e AS (SELECT a.pred_id AS u, b.pred_id AS v FROM v_pred a JOIN v_pred b ON a.pred_id <> b.pred_id AND a.conf > 0.5 AND b.conf > 0.5 AND a.minx <= b.maxx AND b.minx <= a.maxx AND a.miny <= b.maxy AND b.miny <= a.maxy),
 reach AS (SELECT pred_id AS n, pred_id AS low FROM v_pred WHERE conf > 0.5 UNION SELECT e.v, r.low FROM reach r JOIN e ON e.u = r.n),
 comp AS (SELECT n, min(low) AS group_id FROM reach GROUP BY n)
 SELECT group_id, count(*) AS n, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy, arg_max(pred_id, (conf, -pred_id)) AS best_id, arg_max(class_id, (conf, -pred_id)) AS class_id, max(conf) AS conf, CASE WHEN count(*) > 1 THEN 'merged_union' ELSE 'single' END AS source
 FROM v_pred JOIN comp ON comp.n = pred_id GROUP BY group_id""")
def j11_merge_union(spark, sf):
    return Q.merge_union(view(spark, sf, "v_pred").where("conf > 0.5"), "pred_id")


@query("j13_within_tiles", "SELECT gt_id, CAST(floor(minx / 10) AS BIGINT) AS tile_col, CAST(floor(miny / 10) AS BIGINT) AS tile_row FROM v_gt WHERE maxx <= floor(minx / 10) * 10 + 10 AND maxy <= floor(miny / 10) * 10 + 10 AND maxx - minx >= 0.5 AND maxy - miny >= 0.5")
def j13_within_tiles(spark, sf):
    cut = J.clip_to_tiles(view(spark, sf, "v_gt"), 10.0).where("whole and maxx - minx >= 0.5 and maxy - miny >= 0.5")
    return cut.select("gt_id", "tile_col", "tile_row")


@query("j14_clip_to_tiles", """SELECT pred_id, CAST(r AS BIGINT) AS tile_row, CAST(c AS BIGINT) AS tile_col, greatest(minx, c * 10) AS minx, greatest(miny, r * 10) AS miny, least(maxx, c * 10 + 10) AS maxx, least(maxy, r * 10 + 10) AS maxy
 FROM v_pred, range(-1, 26) a(c), range(-1, 400) b(r) WHERE minx < c * 10 + 10 AND maxx > c * 10 AND miny < r * 10 + 10 AND maxy > r * 10""")
def j14_clip_to_tiles(spark, sf):
    return J.clip_to_tiles(view(spark, sf, "v_pred"), 10.0).select("pred_id", "tile_row", "tile_col", *BOX)


_TILE = "SELECT pred_id, class_id, conf, least(greatest((minx - tile_col * 10) / 10, 0), 1) AS x1, least(greatest((maxx - tile_col * 10) / 10, 0), 1) AS x2, least(greatest((tile_row * 10 + 10 - maxy) / 10, 0), 1) AS y1, least(greatest((tile_row * 10 + 10 - miny) / 10, 0), 1) AS y2 FROM v_pred"


@query("j15_j16_tile_labels", f"SELECT pred_id, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2, round((x1 + x2) / 2, 6) AS cx, round((y1 + y2) / 2, 6) AS cy, round(x2 - x1, 6) AS w, round(y2 - y1, 6) AS h FROM ({_TILE}) t")
def j15_j16_tile_labels(spark, sf):
    return L.to_tile(view(spark, sf, "v_pred")).select("pred_id", *(half_up(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2", "cx", "cy", "w", "h")))


@query("j18_rotate_layer", """SELECT pred_id, round(cx + (minx - cx) * cos(radians(17.0::DOUBLE)) - (miny - cy) * sin(radians(17.0::DOUBLE)), 6) AS x0, round(cy + (maxx - cx) * sin(radians(17.0::DOUBLE)) + (maxy - cy) * cos(radians(17.0::DOUBLE)), 6) AS y2
 FROM v_pred, (SELECT (min(minx) + max(maxx)) / 2 AS cx, (min(miny) + max(maxy)) / 2 AS cy FROM v_pred) c""")
def j18_rotate_layer(spark, sf):
    r = J.rotate_layer(view(spark, sf, "v_pred"), 17)
    return r.select("pred_id", F.round(F.get("ring", F.lit(0))["x"], 6).alias("x0"), F.round(F.get("ring", F.lit(2))["y"], 6).alias("y2"))


_ANGLE = "CAST(pred_id % 180 AS DOUBLE)"
_HALF = f"abs((maxx - minx) / 2 * cos(radians({_ANGLE}))) + abs((maxy - miny) / 2 * sin(radians({_ANGLE})))"
_HALF_Y = f"abs((maxx - minx) / 2 * sin(radians({_ANGLE}))) + abs((maxy - miny) / 2 * cos(radians({_ANGLE})))"


@query("j19_j20_turned_boxes", f"SELECT pred_id, round((minx + maxx) / 2 - ({_HALF}), 6) AS x, round((miny + maxy) / 2 - ({_HALF_Y}), 6) AS y, round(2 * ({_HALF}), 6) AS w, round(2 * ({_HALF_Y}), 6) AS h FROM v_pred")
def j19_j20_turned_boxes(spark, sf):
    mid = lambda a, b: (F.col(a) + F.col(b)) / 2
    ring = P.obb_corners(mid("minx", "maxx"), mid("miny", "maxy"), F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"), (F.col("pred_id") % 180).cast("double"))
    x, y, x2, y2 = P.ring_bounds(F.col("ring"))
    return view(spark, sf, "v_pred").withColumn("ring", ring).select("pred_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(x2 - x, 6).alias("w"), F.round(y2 - y, 6).alias("h"))


@query("j21_promote", f"""WITH taken AS (SELECT * FROM v_pred WHERE conf >= 0.6)
 SELECT gt_id AS id, 'truth' AS origin, minx, miny, maxx, maxy FROM v_gt WHERE gt_id NOT IN (SELECT b.gt_id FROM taken a JOIN v_gt b ON {IOU} > 0.3)
 UNION ALL SELECT pred_id, 'promoted', minx, miny, maxx, maxy FROM taken WHERE pred_id NOT IN (SELECT a.pred_id FROM taken a JOIN taken b ON b.pred_id > a.pred_id AND {IOU} > 0.3)""")
def j21_promote(spark, sf):
    return A.promote(*_pair(spark, sf), 0.6)


@query("j23_centres", "SELECT gt_id, (minx + maxx) / 2 AS x, (miny + maxy) / 2 AS y FROM v_gt")
def j23_centres(spark, sf):
    return view(spark, sf, "v_gt").select("gt_id", ((F.col("minx") + F.col("maxx")) / 2).alias("x"), ((F.col("miny") + F.col("maxy")) / 2).alias("y"))


@query("j24_lines_per_tile", """SELECT t.tile_row, t.tile_col, count(g.gt_id) AS n FROM (SELECT DISTINCT tile_row, tile_col FROM v_gt UNION SELECT DISTINCT tile_row, tile_col FROM v_pred) t LEFT JOIN
 (SELECT gt_id, floor(minx / 10) AS c, floor(miny / 10) AS r FROM v_gt WHERE maxx <= floor(minx / 10) * 10 + 10 AND maxy <= floor(miny / 10) * 10 + 10 ) g ON g.r = t.tile_row AND g.c = t.tile_col GROUP BY 1, 2""")
def j24_lines_per_tile(spark, sf):
    """Every tile of either layer, those without a whole truth with 0."""
    pred, gt = _pair(spark, sf)
    tiles = gt.select("tile_row", "tile_col").union(pred.select("tile_row", "tile_col")).distinct()
    n = J.clip_to_tiles(gt, 10.0).where("whole").groupBy("tile_row", "tile_col").agg(F.count(F.lit(1)).alias("n"))
    return tiles.join(n, ["tile_row", "tile_col"], "left").na.fill(0, ["n"])


@query("m14_mask_rectangles")
def m14_mask_rectangles(spark, sf):
    """The smallest turned rectangle of each mask segment, from the ends of its rows."""
    px = G.segment_pixels(mask_pixels(view(spark, sf, "v_pixels")))
    ends = px.groupBy("seg_id", "y").agg(F.min("x").alias("a"), (F.max("x") + 1).alias("b"))
    spots = [F.struct(F.col(x).alias("x"), (F.col("y") + d).alias("y")) for x in "ab" for d in (0, 1)]
    return Q.smallest_rectangles(ends.select("seg_id", F.explode(F.array(*spots)).alias("p")).select("seg_id", "p.*"), "seg_id")


# the mask's segments are upright rectangles of pixels; a diamond of five rows in each tile is added to them
_QUADS = f""", g AS (SELECT seg_id, x % 20 AS x0, y % 20 AS y0, (x + w - 1) % 20 AS x1, (y + h - 1) % 20 AS y1 FROM segs),
 k AS (SELECT -1 - min(pix_id) AS seg_id FROM v_pixels WHERE abs(x % 20 - 8) + abs(y % 20 - 7) <= 2 GROUP BY tile_row, tile_col),
 q AS (SELECT seg_id, x0 AS x1, y0 AS y1, x1 AS x2, y0 AS y2, x1 AS x3, y1 AS y3, x0 AS x4, y1 AS y4 FROM g UNION ALL SELECT seg_id, 6, 7, 8, 5, 10, 7, 8, 9 FROM k)
 SELECT method, seg_id, {', '.join(f'round({c}{i} / 20.0::DOUBLE, 6) AS {c}{i}' for i in range(1, 5) for c in 'xy')} FROM q, (VALUES ('hull'), ('contour'), ('rectangle')) m(method) WHERE method <> 'rectangle' OR seg_id >= 0"""


@query("m14_four_corners", _SEGS + _QUADS)
def m14_four_corners(spark, sf):
    """Mask segments and diamonds as boxes of four corners, by all methods (a diamond's smallest rectangle may lie either way, so it isn't asked for)."""
    p = view(spark, sf, "v_pixels")
    px = G.segment_pixels(mask_pixels(p)).select("seg_id", "x", "y")
    spot = p.where("abs(x % 20 - 8) + abs(y % 20 - 7) <= 2")
    own = F.min("pix_id").over(Window.partitionBy("tile_row", "tile_col"))
    both = px.unionByName(spot.select((-1 - own).alias("seg_id"), "x", "y"))
    found = O.quads_by_method(both, ["hull", "contour", "rectangle"]).where("method <> 'rectangle' or seg_id >= 0")
    return found.select("method", "seg_id", *(F.round(f"{c}{i}", 6).alias(f"{c}{i}") for i in range(1, 5) for c in "xy"))


_D = "sqrt(power(greatest(b.minx - a.maxx, a.minx - b.maxx, 0), 2) + power(greatest(b.miny - a.maxy, a.miny - b.maxy, 0), 2))"


@query("u3_fused_layer", f"""WITH y AS (SELECT pred_id, minx, miny, maxx, maxy, conf FROM v_pred WHERE pred_id % 2 = 1), s AS (SELECT * FROM (SELECT pred_id AS svm_id, minx, miny, maxx, maxy, (margin - min(margin) OVER ()) / (max(margin) OVER () - min(margin) OVER () + 1e-9) AS score FROM v_pred) t WHERE score >= 0.3),
 n AS (SELECT * FROM (SELECT a.svm_id, a.minx, a.miny, a.maxx, a.maxy, a.score, b.conf, {_D} AS d, min({_D}) OVER (PARTITION BY a.svm_id) AS low FROM s a JOIN y b ON {_D} <= 0.25) t WHERE d = low),
 f AS (SELECT minx, miny, maxx, maxy, round(CASE WHEN conf + score > 0 THEN 2 * conf * score / (conf + score) ELSE 0 END, 6) AS confidence, 1 AS k, conf, score FROM n UNION ALL SELECT minx, miny, maxx, maxy, round(conf, 6), 0, conf, NULL FROM y)
 SELECT minx, miny, maxx, maxy, confidence, CASE WHEN k = 1 THEN 'both' ELSE 'first' END AS source FROM (SELECT *, row_number() OVER (PARTITION BY minx, miny, maxx, maxy ORDER BY confidence DESC, k DESC, conf DESC, coalesce(score, -1) DESC) AS r FROM f) z WHERE r = 1""")
def u3_fused_layer(spark, sf):
    p = view(spark, sf, "v_pred")
    first, second = p.where("pred_id % 2 = 1"), p.select(F.col("pred_id").alias("svm_id"), *BOX, "margin")
    return J.fuse_layers(first, second, 0.25).select(*BOX, "confidence", "source")


@query("u4_tags", f"SELECT pred_id, CASE WHEN score >= 0.5 AND truth = 1 THEN 'TP' WHEN score >= 0.5 THEN 'FP' WHEN truth = 1 THEN 'FN' ELSE 'TN' END AS result FROM {_TRUTH} t")
def u4_tags(spark, sf):
    return J.tagged(_scored(spark, sf), 0.5).select("pred_id", "result")


@query("u6_weighted_confidence", f"SELECT p.pred_id, round(0.6 * conf + 0.4 * margin / 6 + 0.2 * coalesce(iou, 0), 6) AS added, round((0.6 * conf + 0.4 * margin / 6) * coalesce(iou, 0), 6) AS scaled FROM v_pred p LEFT JOIN {_BEST} m ON m.pred_id = p.pred_id")
def u6_weighted_confidence(spark, sf):
    pred, gt = _pair(spark, sf)
    base = F.col("conf") * 0.6 + F.col("margin") * 0.4 / 6
    overlap = F.coalesce("iou", F.lit(0.0))
    return pred.join(J.best_match(pred, gt), "pred_id").select("pred_id", (base + overlap * 0.2).alias("added"), (base * overlap).alias("scaled")).select("pred_id", half_up("added", 6).alias("added"), half_up("scaled", 6).alias("scaled"))


_FIELD = "CASE tile_col % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'mid' ELSE 'large' END"


@query("u5_a12_fields", f"""WITH m AS (SELECT {_FIELD} AS field, p.pred_id, b.gt_id FROM v_pred p LEFT JOIN (SELECT * FROM {_BEST} x WHERE iou >= 0.5) b ON b.pred_id = p.pred_id),
 t AS (SELECT field, count(gt_id) AS tp, count(*) - count(gt_id) AS fp FROM m GROUP BY field),
 g AS (SELECT {_FIELD} AS field, count(*) AS n, count(h.gt_id) AS met FROM v_gt v LEFT JOIN (SELECT DISTINCT gt_id FROM m) h ON h.gt_id = v.gt_id GROUP BY 1), u AS (SELECT t.field, tp, fp, n - met AS fn FROM t JOIN g ON g.field = t.field)
 SELECT coalesce(field, 'all') AS field, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM u GROUP BY ROLLUP (field)""")
def u5_a12_fields(spark, sf):
    """Counts of each field and their sums."""
    pred, gt = (d.withColumn("field", F.expr(_FIELD)) for d in _pair(spark, sf))
    hit = J.best_match(pred, gt).where("iou >= 0.5").select("pred_id", "gt_id")
    t = pred.join(hit, "pred_id", "left").groupBy("field").agg(F.count("gt_id").alias("tp"), (F.count(F.lit(1)) - F.count("gt_id")).alias("fp"))
    missed = gt.join(hit.select("gt_id").distinct(), "gt_id", "left_anti").groupBy("field").agg(F.count(F.lit(1)).alias("fn"))
    by = t.join(missed, "field", "full_outer").na.fill(0)
    return by.rollup("field").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))).select(F.coalesce("field", F.lit("all")).alias("field"), "tp", "fp", "fn")


_B4 = "minx, miny, maxx, maxy"
_RUN = f"""WITH RECURSIVE p AS (SELECT *, {_FIELD} AS field FROM v_pred), t AS (SELECT *, {_FIELD} AS field FROM v_gt),
 y AS (SELECT field, pred_id, {_B4}, conf FROM p WHERE pred_id % 2 = 1),
 s0 AS (SELECT field, pred_id, {_B4}, (margin - min(margin) OVER w) / (max(margin) OVER w - min(margin) OVER w + 1e-9) AS score FROM p WHERE pred_id % 2 = 0 WINDOW w AS (PARTITION BY field)),
 n AS (SELECT * FROM (SELECT a.field, a.pred_id, a.minx, a.miny, a.maxx, a.maxy, a.score, b.conf, {_D} AS d, min({_D}) OVER (PARTITION BY a.field, a.pred_id) AS low FROM s0 a JOIN y b ON a.field = b.field AND {_D} <= 0.25 WHERE a.score >= 0.3) z WHERE d = low),
 f AS (SELECT field, {_B4}, round(CASE WHEN conf + score > 0 THEN 2 * conf * score / (conf + score) ELSE 0 END, 6) AS confidence, 1 AS k, conf, score FROM n UNION ALL SELECT field, {_B4}, round(conf, 6), 0, conf, NULL FROM y),
 u AS (SELECT *, row_number() OVER (ORDER BY field, {_B4}) AS id FROM (SELECT *, row_number() OVER (PARTITION BY field, {_B4} ORDER BY confidence DESC, k DESC, conf DESC, coalesce(score, -1) DESC) AS r FROM f) z WHERE r = 1),
 e AS (SELECT a.id AS u, b.id AS v FROM u a JOIN u b ON a.field = b.field AND a.id <> b.id AND a.minx <= b.maxx AND b.minx <= a.maxx AND a.miny <= b.maxy AND b.miny <= a.maxy),
 reach AS (SELECT id AS n, id AS low FROM u UNION SELECT e.v, r.low FROM reach r JOIN e ON e.u = r.n), comp AS (SELECT n, min(low) AS g FROM reach GROUP BY n),
 layers AS (SELECT field, 'first' AS layer, pred_id AS id, {_B4} FROM y UNION ALL SELECT field, 'second', pred_id, {_B4} FROM s0
  UNION ALL SELECT any_value(field), 'fused', g, min(minx), min(miny), max(maxx), max(maxy) FROM u JOIN comp ON comp.n = u.id GROUP BY g),
 m AS (SELECT a.field, layer, id, arg_max(b.gt_id, ({IOU}, -b.gt_id)) AS gt_id FROM layers a JOIN t b ON a.field = b.field AND {IOU} > 0 GROUP BY 1, 2, 3 HAVING max({IOU}) >= 0.5),
 c AS (SELECT l.field, l.layer, tp, n - tp AS fp, all_gt - met AS fn FROM (SELECT field, layer, count(*) AS n FROM layers GROUP BY 1, 2) l JOIN (SELECT field, layer, count(*) AS tp, count(DISTINCT gt_id) AS met FROM m GROUP BY 1, 2) h ON h.field = l.field AND h.layer = l.layer
  JOIN (SELECT field, count(*) AS all_gt FROM t GROUP BY 1) q ON q.field = l.field),
 a AS (SELECT * FROM c UNION ALL SELECT 'all', layer, sum(tp), sum(fp), sum(fn) FROM c GROUP BY layer)
 SELECT field, layer, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(tp / (tp + fp)::DOUBLE, 4) AS precision, round(tp / (tp + fn)::DOUBLE, 4) AS recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 4) AS f1, round(tp / (tp + fp + fn)::DOUBLE, 4) AS accuracy FROM a"""


@query("u5_fusion_run", _RUN)
def u5_fusion_run(spark, sf):
    """The whole fusion of two detectors on each of three fields, with the counts of both, of their fusion, and of all fields."""
    pred, gt = (d.withColumn("field", F.expr(_FIELD)) for d in _pair(spark, sf))
    runs = {}
    for field in ("small", "mid", "large"):
        p, t = pred.where(F.col("field") == field), gt.where(F.col("field") == field)
        first, second = p.where("pred_id % 2 = 1"), p.where("pred_id % 2 = 0").select(F.col("pred_id").alias("svm_id"), *BOX, "margin")
        runs[field] = U.fusion_run(first, second, t, 0.25)
    return U.fusion_report(runs)


@query("a2_image_confusion")
def a2_image_confusion(spark, sf):
    """As a2_a3_confusion, with labels in units of their images."""
    return J.scores(J.confusion(*map(_image_units, _pair(spark, sf)), size=0.125, on=IMAGE))


ORACLE_SQL["a2_image_confusion"] = ORACLE_SQL["a2_a3_confusion"]


@query("a4_confusion_shares")
def a4_confusion_shares(spark, sf):
    total = F.col("tp") + F.col("fp") + F.col("fn")
    return a2_a3_confusion(spark, sf).select(*(F.round(F.col(c) / F.when(total > 0, total), 6).alias(c) for c in ("tp", "fp", "fn")))


ORACLE_SQL["a4_confusion_shares"] = "SELECT round(tp / (tp + fp + fn)::DOUBLE, 6) AS tp, round(fp / (tp + fp + fn)::DOUBLE, 6) AS fp, round(fn / (tp + fp + fn)::DOUBLE, 6) AS fn FROM (" + ORACLE_SQL["a2_a3_confusion"] + ") t"


@query("a5_auc", f"SELECT round(sum(CASE WHEN p.score > n.score THEN 1 WHEN p.score = n.score THEN 0.5 ELSE 0 END) / count(*)::DOUBLE, 6) AS auc FROM {_TRUTH} p, {_TRUTH} n WHERE p.truth = 1 AND n.truth = 0")
def a5_auc(spark, sf):
    return J.auc(J.roc_points(_scored(spark, sf))).withColumn("auc", F.round("auc", 6))


_SWEEP = f"""WITH best AS (SELECT gt_id, max(conf) AS conf FROM (SELECT a.conf, b.gt_id, {IOU} AS iou FROM v_pred a JOIN v_gt b ON a.class_id = b.class_id AND {IOU} >= 0.5) p GROUP BY gt_id),
 level AS (SELECT CASE WHEN i = 199 THEN 0.001::DOUBLE ELSE 1::DOUBLE + i * ((0.001::DOUBLE - 1::DOUBLE) / 199) END AS t FROM range(200) r(i)),
 c AS (SELECT t, (SELECT count(*) FROM best WHERE conf >= t) AS tp, (SELECT count(*) FROM v_pred WHERE conf >= t) AS n, (SELECT count(*) FROM v_gt) AS m FROM level),
 sweep AS (SELECT t AS threshold, tp, n - tp AS fp, m - tp AS fn, tp / (n + 1e-9) AS precision, tp / (m + 1e-9) AS recall FROM c)"""


@query("a7_pr_sweep", f"{_SWEEP} SELECT round(threshold, 6) AS threshold, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall FROM sweep")
def a7_pr_sweep(spark, sf):
    points = A.pr_sweep(*_pair(spark, sf))
    return points.select(F.round("threshold", 6).alias("threshold"), "tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("a7_average_precision", f"""{_SWEEP}, e AS (SELECT recall, threshold, max(precision) OVER (ORDER BY recall, threshold DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p FROM sweep)
 SELECT round(sum(a), 6) AS ap FROM (SELECT (recall - lag(recall) OVER w) * (p + lag(p) OVER w) / 2 AS a FROM e WINDOW w AS (ORDER BY recall, threshold DESC)) z""")
def a7_average_precision(spark, sf):
    return A.average_precision(A.pr_sweep(*_pair(spark, sf))).withColumn("ap", F.round("ap", 6))


@query("a7_image_sweep", f"{_SWEEP} SELECT round(threshold, 6) AS threshold, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall FROM sweep")
def a7_image_sweep(spark, sf):
    """As a7_pr_sweep, with labels in units of their images."""
    points = A.pr_sweep(*map(_image_units, _pair(spark, sf)), size=0.125, on=IMAGE)
    return points.select(F.round("threshold", 6).alias("threshold"), "tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def _run_sql(run: int) -> str:
    kept = f"(SELECT * FROM v_pred WHERE pred_id % 2 = {run} AND conf >= 0.3 AND (tile_row, tile_col) IN (SELECT (tile_row, tile_col) FROM v_gt))"
    return f"SELECT {run} AS run, (SELECT count(*) FROM {_ONE.format(iou=IOU, pred=kept)} o) AS tp, (SELECT count(*) FROM {kept} k) AS n, (SELECT count(*) FROM v_gt) AS m, (SELECT avg(conf) FROM {kept} k) AS mean_conf"


@query("a8_a9_evaluate_runs", f"""SELECT run, tp, n - tp AS fp, m - tp AS fn, round(mean_conf, 6) AS mean_conf, round(tp / n::DOUBLE, 4) AS precision, round(tp / m::DOUBLE, 4) AS recall, round(2 * tp / (n + m)::DOUBLE, 4) AS f1, round(tp / (n + m - tp)::DOUBLE, 4) AS accuracy
 FROM ({_run_sql(0)} UNION ALL {_run_sql(1)}) r""")
def a8_a9_evaluate_runs(spark, sf):
    """Scores of two runs, told apart by the predictions' ids."""
    pred, gt = _pair(spark, sf)
    runs = None
    for r in (0, 1):
        one = J.scores(A.evaluate(pred.where(F.col("pred_id") % 2 == r), gt, ["tile_row", "tile_col"])).withColumn("run", F.lit(r))
        runs = one if runs is None else runs.unionByName(one)
    return runs.withColumn("mean_conf", F.round("mean_conf", 6))


@query("a9_image_runs")
def a9_image_runs(spark, sf):
    """As a8_a9_evaluate_runs, with labels in units of their images, and matched by components within them."""
    pred, gt = map(_image_units, _pair(spark, sf))
    runs = [J.scores(A.evaluate(pred.where(F.col("pred_id") % 2 == r), gt, IMAGE, size=0.125, split=True)).withColumn("run", F.lit(r)) for r in (0, 1)]
    return runs[0].unionByName(runs[1]).withColumn("mean_conf", F.round("mean_conf", 6))


ORACLE_SQL["a9_image_runs"] = ORACLE_SQL["a8_a9_evaluate_runs"]


_SIDE = lambda f, *at: f"{f}(" + ", ".join(f"c[{i}]" for i in at) + ")"
_X, _Y = (1, 3, 5, 7), (2, 4, 6, 8)
_MAP = f"""SELECT line_no AS pred_id, CAST(t[1] AS INTEGER) AS class_id, CASE WHEN k IN (1, 3) THEN CAST(t[2] AS DOUBLE) ELSE 1 END AS conf,
 (col + CASE WHEN k < 2 THEN c[1] - c[3] / 2 ELSE {_SIDE('least', *_X)} END) * 10 AS minx, (col + CASE WHEN k < 2 THEN c[1] + c[3] / 2 ELSE {_SIDE('greatest', *_X)} END) * 10 AS maxx,
 (row_ + 1 - CASE WHEN k < 2 THEN c[2] + c[4] / 2 ELSE {_SIDE('greatest', *_Y)} END) * 10 AS miny, (row_ + 1 - CASE WHEN k < 2 THEN c[2] - c[4] / 2 ELSE {_SIDE('least', *_Y)} END) * 10 AS maxy
 FROM (SELECT *, CAST(regexp_extract(stem, 'tile_([0-9]+)_([0-9]+)', 1) AS INTEGER) AS row_, CAST(regexp_extract(stem, 'tile_([0-9]+)_([0-9]+)', 2) AS INTEGER) AS col FROM {_BOUNDS} y) z"""


@query("j25_merged_map_layer", f"""WITH RECURSIVE m AS ({_MAP}), e AS (SELECT a.pred_id AS u, b.pred_id AS v FROM m a JOIN m b ON a.pred_id <> b.pred_id AND {RATIO} >= 0.1),
 reach AS (SELECT pred_id AS n, pred_id AS low FROM m UNION SELECT e.v, r.low FROM reach r JOIN e ON e.u = r.n), comp AS (SELECT n, min(low) AS group_id FROM reach GROUP BY n)
 SELECT group_id, count(*) AS n, round(min(minx), 6) AS minx, round(min(miny), 6) AS miny, round(max(maxx), 6) AS maxx, round(max(maxy), 6) AS maxy, max(conf) AS conf, arg_min(class_id, pred_id) AS class_id
 FROM m JOIN comp ON comp.n = pred_id GROUP BY group_id HAVING (max(maxx) - min(minx)) * (max(maxy) - min(miny)) BETWEEN 0.003 AND 0.41""")
def j25_merged_map_layer(spark, sf):
    """Label files to map boxes, merged where they overlap, of bounded area."""
    lines = L.parse_labels(view(spark, sf, "v_label_lines"))
    m = L.to_map(L.bounds(lines)).select(F.col("line_no").alias("pred_id"), "class_id", F.coalesce("conf", F.lit(1.0)).alias("conf"), *(F.col(f"map_{c}").alias(c) for c in BOX))
    merged = J.merge_boxes(stored(m), "pred_id", 0.1)
    area = (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))
    return merged.where(area.between(0.003, 0.41)).select("group_id", "n", *(F.round(c, 6).alias(c) for c in BOX), "conf", "class_id")



"""Queries on colours, composites, masks of polygons and boxes, and affine maps."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from agrispark.functions import color as K, geometry as P, spectral as S
from agrispark.operators import composites as C, normalize as N, segments as G
from agrispark.plans.fixtures import view
from agrispark.plans.register import query
from agrispark.plans.registry import _SEGS, mask_pixels

BANDS = ["red", "green", "blue", "ext_green", "ext_red", "rededge", "nir"]
_RGB8 = "SELECT *, " + ", ".join(f"CAST(floor({b} / 65535.0 * 255) AS INTEGER) AS {b[0]}8" for b in ("red", "green", "blue")) + " FROM v_pixels"


def _rgb8(spark, sf):
    return view(spark, sf, "v_pixels").select("*", *(F.floor(F.col(b) / 65535.0 * 255).cast("int").alias(f"{b[0]}8") for b in ("red", "green", "blue")))


# --- sources ---------------------------------------------------------------------------------------------------

@query("s2_s3_band_stack", "SELECT pix_id, b.band, b.v FROM (SELECT pix_id, unnest([{'band': 1, 'v': red}, {'band': 7, 'v': nir}, {'band': 4, 'v': ext_green}]) AS b FROM v_pixels) t")
def s2_s3_band_stack(spark, sf):
    names = ["red", "nir", 4]
    rows = [F.struct(F.lit(i).alias("band"), F.col(BANDS[i - 1]).alias("v")) for i in S.band_refs(names, BANDS)]
    return view(spark, sf, "v_pixels").select("pix_id", F.explode(F.array(*rows)).alias("b")).select("pix_id", "b.*")


@query("s11_corrupt_windows", "SELECT tile_row, tile_col, CAST(sum(CASE WHEN noise % 13 = 0 THEN 0 ELSE nir END) AS BIGINT) AS total, CAST(sum(CASE WHEN noise % 13 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS bad FROM v_pixels GROUP BY 1, 2")
def s11_corrupt_windows(spark, sf):
    holed = view(spark, sf, "v_pixels").withColumn("nir", F.when(F.col("noise") % 13 != 0, F.col("nir")))
    return holed.groupBy("tile_row", "tile_col").agg(F.sum(F.coalesce("nir", F.lit(0))).alias("total"), F.count_if(F.col("nir").isNull()).alias("bad"))


# --- stretches -------------------------------------------------------------------------------------------------

@query("n5_sampled_range", """SELECT round(quantile_cont(v, 0.02), 6) AS lo, round(quantile_cont(v, 0.98), 6) AS hi FROM (SELECT CAST(unnest([red, green, nir]) AS DOUBLE) AS v FROM v_pixels, (SELECT max(y) + 1 AS h FROM v_pixels) s
 WHERE y % greatest(CAST(floor(h / 10.0) AS INTEGER), 1) = 0 AND x % 10 = 0) t WHERE v < 65535""")
def n5_sampled_range(spark, sf):
    p = view(spark, sf, "v_pixels")
    height = p.agg(F.max("y") + 1).first()[0]
    return C.sampled_range(p, ["red", "green", "nir"], height, 10, 0.02, 0.98).select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query("n9_index_u8", f"""SELECT pix_id, CAST(floor((least(greatest({S.formula_sql('NDVI')}, -1), 1) + 1) / 2 * 255) AS INTEGER) AS ndvi, CAST(floor((least(greatest({S.formula_sql('NGRDI')}, -1), 1) + 1) / 2 * 255) AS INTEGER) AS ngrdi,
 CAST(floor(least(greatest({S.formula_sql('RVI')}, 0), 9) / 9 * 255) AS INTEGER) AS rvi FROM v_pixels""")
def n9_index_u8(spark, sf):
    u = lambda n, lo, hi: S.fixed_u8(S.index(n), lo, hi).alias(n.lower())
    return view(spark, sf, "v_pixels").select("pix_id", u("NDVI", -1.0, 1.0), u("NGRDI", -1.0, 1.0), u("RVI", 0.0, 9.0))


@query("n10_linear_stretch", "SELECT pix_id, CAST(round_even(least(greatest((nir - 6000) / 12000.0::DOUBLE, 0), 1) * 65535, 0) AS INTEGER) AS nir, 32767 AS flat FROM v_pixels")
def n10_linear_stretch(spark, sf):
    return view(spark, sf, "v_pixels").select("pix_id", N.linear_stretch(F.col("nir"), 6000.0, 18000.0, 65535.0).alias("nir"), N.linear_stretch(F.col("nir"), 5.0, 5.0, 65535.0).alias("flat"))


_AUTO = "v_pixels, (SELECT " + ", ".join(f"min({S.formula_sql(n)}) AS {n.lower()}_lo, max({S.formula_sql(n)}) AS {n.lower()}_hi" for n in ("NGRDI", "RVI", "SAVI")) + " FROM v_pixels) s"


def _auto(n: str) -> str:
    v, lo, hi = S.formula_sql(n), f"{n.lower()}_lo", f"{n.lower()}_hi"
    return f"round(CASE WHEN {lo} < 0 THEN ({v} - {lo}) / ({hi} - {lo}) * greatest({hi}, 25000) WHEN {hi} <= 1 THEN {v} * greatest({hi}, 25000) WHEN {hi} <= 255 THEN {v} / 255 * greatest({hi}, 25000) ELSE {v} END, 4) AS {n.lower()}"


@query("n11_rescale_auto", f"SELECT pix_id, {_auto('NGRDI')}, {_auto('RVI')}, {_auto('SAVI')} FROM {_AUTO}")
def n11_rescale_auto(spark, sf):
    p = S.indices(view(spark, sf, "v_pixels"), ["NGRDI", "RVI", "SAVI"])
    for n in ("ngrdi", "rvi", "savi"):
        p = C.rescale_auto(p, n, n)
    return p.select("pix_id", *(F.round(n, 4).alias(n) for n in ("ngrdi", "rvi", "savi")))


# --- colours and composites ------------------------------------------------------------------------------------

_HSV = f"""SELECT *, greatest(r8, g8, b8) AS v, CASE WHEN greatest(r8, g8, b8) = 0 THEN 0 ELSE (greatest(r8, g8, b8) - least(r8, g8, b8)) * 255.0::DOUBLE / greatest(r8, g8, b8) END AS s,
 (CASE WHEN greatest(r8, g8, b8) = least(r8, g8, b8) THEN 0 WHEN r8 = greatest(r8, g8, b8) THEN (g8 - b8) * 30.0::DOUBLE / (greatest(r8, g8, b8) - least(r8, g8, b8))
 WHEN g8 = greatest(r8, g8, b8) THEN (b8 - r8) * 30.0::DOUBLE / (greatest(r8, g8, b8) - least(r8, g8, b8)) + 60 ELSE (r8 - g8) * 30.0::DOUBLE / (greatest(r8, g8, b8) - least(r8, g8, b8)) + 120 END + 180) % 180 AS h FROM ({_RGB8}) c"""


@query("n13_green_mask", f"SELECT pix_id, CASE WHEN round_even(h, 0) BETWEEN 35 AND 85 AND round_even(s, 0) >= 40 AND v >= 40 THEN 1 ELSE 0 END AS mask FROM ({_HSV}) t")
def n13_green_mask(spark, sf):
    return _rgb8(spark, sf).select("pix_id", K.green_mask(F.col("r8"), F.col("g8"), F.col("b8")).alias("mask"))


def _lin(c: str) -> str:
    return f"CASE WHEN {c} / 255.0::DOUBLE > 0.04045 THEN pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) ELSE {c} / 255.0::DOUBLE / 12.92 END"


def _cbrt(c: str) -> str:
    return f"CASE WHEN {c} > 0.008856 THEN pow({c}, 1 / 3.0::DOUBLE) ELSE 7.787 * {c} + 16 / 116.0::DOUBLE END"


_LAB = f"""SELECT *, (116 * fy - 16) * 255 / 100 AS lab_l, 500 * (fx - fy) + 128 AS lab_a, 200 * (fy - fz) + 128 AS lab_b FROM (SELECT *, {_cbrt('cx')} AS fx, {_cbrt('cy')} AS fy, {_cbrt('cz')} AS fz
 FROM (SELECT *, (0.412453::DOUBLE * lr + 0.357580::DOUBLE * lg + 0.180423::DOUBLE * lb) / 0.950456::DOUBLE AS cx, 0.212671::DOUBLE * lr + 0.715160::DOUBLE * lg + 0.072169::DOUBLE * lb AS cy,
 (0.019334::DOUBLE * lr + 0.119193::DOUBLE * lg + 0.950227::DOUBLE * lb) / 1.088754::DOUBLE AS cz FROM (SELECT *, {_lin('r8')} AS lr, {_lin('g8')} AS lg, {_lin('b8')} AS lb FROM ({_RGB8}) c) d) e) f"""


@query("n14_gray_hsv_lab", f"SELECT h.pix_id, CAST(round_even(h.r8 * 0.299::DOUBLE + h.g8 * 0.587::DOUBLE + h.b8 * 0.114::DOUBLE, 0) AS INTEGER) AS gray, round(h, 5) AS h, round(s, 5) AS s, round(lab_l, 4) AS l, round(lab_a, 4) AS a, round(lab_b, 4) AS b FROM ({_HSV}) h JOIN ({_LAB}) l ON h.pix_id = l.pix_id")
def n14_gray_hsv_lab(spark, sf):
    rgb = [F.col(c) for c in ("r8", "g8", "b8")]
    h, s, _ = K.hsv(*rgb)
    lab = [F.round(c, 4).alias(n) for c, n in zip(K.lab(*rgb), "lab", strict=True)]
    return _rgb8(spark, sf).select("pix_id", K.gray(*rgb).alias("gray"), F.round(h, 5).alias("h"), F.round(s, 5).alias("s"), *lab)


def _value(part) -> str:
    return "CAST(0 AS DOUBLE)" if part == 0 else S.formula_sql(part) if part in S.FORMULAS else f"CAST({part} AS DOUBLE)"


def _stack_sql(parts, names, joint=False) -> str:
    w = "WINDOW w AS (PARTITION BY tile_row, tile_col)"
    lo = [f"min(v{i}) OVER w" for i in range(len(parts))]
    hi = [f"max(v{i}) OVER w" for i in range(len(parts))]
    if joint:
        lo, hi = ["least(" + ", ".join(lo) + ")"] * len(parts), ["greatest(" + ", ".join(hi) + ")"] * len(parts)
    out = ", ".join(f"CAST(CASE WHEN {hi[i]} > {lo[i]} THEN floor((v{i} - {lo[i]}) / ({hi[i]} - {lo[i]}) * 255) ELSE 0 END AS INTEGER) AS {n}" for i, n in enumerate(names))
    return f"SELECT pix_id, {out} FROM (SELECT pix_id, tile_row, tile_col, " + ", ".join(f"{_value(p)} AS v{i}" for i, p in enumerate(parts)) + f" FROM v_pixels) t {w}"


@query("n15_composites", " UNION ALL ".join(f"SELECT '{n}' AS composite, * FROM ({_stack_sql(p, ['c1', 'c2', 'c3'])}) z" for n, p in C.COMPOSITES.items()))
def n15_composites(spark, sf):
    p = view(spark, sf, "v_pixels")
    out = None
    for n in C.COMPOSITES:
        one = C.composite(p, n).select(F.lit(n).alias("composite"), "pix_id", "c1", "c2", "c3")
        out = one if out is None else out.unionByName(one)
    return out


@query("n16_nen_composite", _stack_sql(["NGRDI", "ext_red", "nir"], ["c1", "c2", "c3"], joint=True))
def n16_nen_composite(spark, sf):
    return C.composite(view(spark, sf, "v_pixels"), "NEN").select("pix_id", "c1", "c2", "c3")


def _blend(b: str) -> str:
    lo, hi = f"(min({b}) OVER w * 0.1::DOUBLE + g{b}lo * 0.9::DOUBLE)", f"(max({b}) OVER w * 0.1::DOUBLE + g{b}hi * 0.9::DOUBLE)"
    return f"CAST(floor(least(greatest(({b} - {lo}) / ({hi} - {lo} + 0.000001::DOUBLE), 0), 1) * 255) AS INTEGER)"


@query("n17_nrn_global", f"""SELECT pix_id, {_blend('nir')} AS c1, {_blend('red')} AS c2, CAST(floor((least(greatest({S.formula_sql('NGRDI')}, -1), 1) + 1) / (2 + 0.000001::DOUBLE) * 255) AS INTEGER) AS c3 FROM v_pixels,
 (SELECT avg(nl::DOUBLE) AS gnirlo, avg(nh::DOUBLE) AS gnirhi, avg(rl::DOUBLE) AS gredlo, avg(rh::DOUBLE) AS gredhi FROM (SELECT min(nir) AS nl, max(nir) AS nh, min(red) AS rl, max(red) AS rh FROM v_pixels GROUP BY tile_row, tile_col) q) g
 WINDOW w AS (PARTITION BY tile_row, tile_col)""")
def n17_nrn_global(spark, sf):
    return C.global_composite(view(spark, sf, "v_pixels"), "NRN").select("pix_id", "c1", "c2", "c3")


@query("n18_band_orders", " UNION ALL ".join(f"SELECT pix_id, '{a}-{b}-{c}' AS channels, {a} AS c1, {b} AS c2, {c} AS c3 FROM v_pixels"
       for a, b, c in (("red", "green", "nir"), ("red", "nir", "green"), ("green", "red", "nir"), ("green", "nir", "red"), ("nir", "red", "green"), ("nir", "green", "red"))))
def n18_band_orders(spark, sf):
    return C.band_orders(view(spark, sf, "v_pixels"), ("red", "green", "nir"))


@query("n19_n21_band_stack", _stack_sql(["nir", "rededge", "NDVI", "EXG"], ["nir", "rededge", "ndvi", "exg"]))
def n19_n21_band_stack(spark, sf):
    return C.band_stack(view(spark, sf, "v_pixels"), ["nir", "rededge", "NDVI", "EXG"]).select("pix_id", "nir", "rededge", "ndvi", "exg")


# --- masks -----------------------------------------------------------------------------------------------------

@query("m2_inverse_mask", "SELECT pix_id, CASE WHEN CAST(floor(ext_red / 65535.0 * 255) AS INTEGER) <= 22 THEN 1 ELSE 0 END AS mask FROM v_pixels")
def m2_inverse_mask(spark, sf):
    return view(spark, sf, "v_pixels").select("pix_id", (F.floor(F.col("ext_red") / 65535.0 * 255) <= 22).cast("int").alias("mask"))


@query("m6_lab_mask", f"""WITH p AS (SELECT *, CAST(round_even(round(lab_a, 4), 0) AS INTEGER) AS v FROM ({_LAB}) l), t AS (SELECT tile_row AS tr, tile_col AS tc, arg_min(v, (-round(b, 3), v)) AS threshold FROM (SELECT tile_row, tile_col, v,
 CASE WHEN w > w0 THEN w0::DOUBLE * (w - w0) * (s0 / w0::DOUBLE - (s - s0) / (w - w0)::DOUBLE) * (s0 / w0::DOUBLE - (s - s0) / (w - w0)::DOUBLE) ELSE 0 END AS b
 FROM (SELECT tile_row, tile_col, v, sum(n) OVER u AS w0, sum(n * v) OVER u AS s0, sum(n) OVER (PARTITION BY tile_row, tile_col) AS w, sum(n * v) OVER (PARTITION BY tile_row, tile_col) AS s
 FROM (SELECT tile_row, tile_col, v, count(*) AS n FROM p GROUP BY 1, 2, 3) h WINDOW u AS (PARTITION BY tile_row, tile_col ORDER BY v)) r) q GROUP BY 1, 2)
 SELECT pix_id, CASE WHEN v > threshold THEN 1 ELSE 0 END AS mask FROM p JOIN t ON tr = tile_row AND tc = tile_col""")
def m6_lab_mask(spark, sf):
    a = K.lab(F.col("r8"), F.col("g8"), F.col("b8"))[1]
    p = _rgb8(spark, sf).withColumn("v", F.bround(F.round(a, 4)).cast("int"))
    cut = N.otsu(p, "v")
    return p.join(cut, ["tile_row", "tile_col"]).select("pix_id", (F.col("v") > F.col("threshold")).cast("int").alias("mask"))


_MEMBERS = _SEGS.replace(" segs AS (", """ member AS (SELECT p.pix_id, p.x, p.y, c.low AS seg_id FROM (SELECT run, min(low) AS low FROM reach GROUP BY run) c JOIN runs r ON r.run = c.run JOIN v_pixels p
 ON p.tile_row = r.tile_row AND p.tile_col = r.tile_col AND p.y = r.y AND p.x BETWEEN r.x0 AND r.x1), segs AS (""")


@query("m10_m11_segment_pixels", _MEMBERS + "SELECT pix_id, x, y, seg_id FROM member WHERE seg_id IN (SELECT seg_id FROM member GROUP BY seg_id HAVING count(*) >= 9)")
def m10_m11_segment_pixels(spark, sf):
    px = G.segment_pixels(mask_pixels(view(spark, sf, "v_pixels"))).select("pix_id", "x", "y", "seg_id")
    return px.join(px.groupBy("seg_id").count().where("count >= 9"), "seg_id", "left_semi").select("pix_id", "x", "y", "seg_id")


_DIAMOND = [("(minx + maxx)", "miny * 2"), ("maxx * 2", "(miny + maxy)"), ("(minx + maxx)", "maxy * 2"), ("minx * 2", "(miny + maxy)")]
_CROSS = " + ".join(
    f"CASE WHEN (({ay}) > y + 0.5) <> (({by}) > y + 0.5) THEN CASE WHEN x + 0.5 < {ax} + (y + 0.5 - {ay}) * ({bx} - {ax}) / nullif({by} - {ay}, 0) THEN 1 ELSE 0 END ELSE 0 END"
    for (ax, ay), (bx, by) in zip(_DIAMOND, _DIAMOND[1:] + _DIAMOND[:1], strict=True)
)


@query("m13_pixels_in_polygons", f"SELECT pred_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM (SELECT *, unnest(range(CAST(floor(minx * 2) AS BIGINT), CAST(floor(maxx * 2) AS BIGINT) + 1)) AS x FROM (SELECT *, unnest(range(CAST(floor(miny * 2) AS BIGINT), CAST(floor(maxy * 2) AS BIGINT) + 1)) AS y FROM v_pred) a) b WHERE ({_CROSS}) % 2 = 1")
def m13_pixels_in_polygons(spark, sf):
    ring = F.array(*(F.struct(F.expr(x).alias("x"), F.expr(y).alias("y")) for x, y in _DIAMOND))
    return G.pixels_in_rings(view(spark, sf, "v_pred").select("pred_id", ring.alias("ring")), "pred_id")


@query("m15_mask_classes", "SELECT DISTINCT CAST(noise % 5 AS INTEGER) AS class_id FROM v_pixels WHERE blob = 1 AND noise % 5 <> 0")
def m15_mask_classes(spark, sf):
    mask = view(spark, sf, "v_pixels").select(F.when(F.col("blob") == 1, F.col("noise") % 5).otherwise(0).cast("int").alias("class_id"))
    return mask.where("class_id <> 0").distinct()


@query("m17_bbox_mask", _SEGS + """SELECT DISTINCT p.pix_id FROM segs s JOIN v_pixels p ON p.x BETWEEN s.x - CAST(floor(s.w / 2.0) AS INTEGER) AND s.x - CAST(floor(s.w / 2.0) AS INTEGER) + s.w - 1 AND p.y BETWEEN s.y - CAST(floor(s.h / 2.0) AS INTEGER) AND s.y - CAST(floor(s.h / 2.0) AS INTEGER) + s.h - 1""")
def m17_bbox_mask(spark, sf):
    p = view(spark, sf, "v_pixels")
    centred = [(F.col(c) - F.floor(F.col(n) / 2)).cast("int").alias(c) for c, n in (("x", "w"), ("y", "h"))]
    boxes = G.segments(mask_pixels(p)).select("seg_id", *centred, F.col("w").cast("int").alias("w"), F.col("h").cast("int").alias("h"))
    return p.join(G.box_pixels(boxes, "seg_id").select("x", "y").distinct(), ["x", "y"]).select("pix_id")


@query("m12_tighten_boxes", _SEGS + """SELECT seg_id AS box_id, CAST(s.x AS INTEGER) AS x, CAST(s.y AS INTEGER) AS y, CAST(s.w AS INTEGER) AS w, CAST(s.h AS INTEGER) AS h, s.n_px FROM segs s""")
def m12_tighten_boxes(spark, sf):
    """Boxes three pixels wider than the segments they hold come back to them."""
    p = mask_pixels(view(spark, sf, "v_pixels"))
    wide = G.segments(p).select(F.col("seg_id").alias("box_id"), *((F.col(c) - 3).cast("int").alias(c) for c in "xy"), *((F.col(c) + 6).cast("int").alias(c) for c in "wh"))
    return G.tighten_boxes(wide, p, "box_id")


# --- places ----------------------------------------------------------------------------------------------------

_MAP = P.Affine(0.25, 0.0, 1000.0, 0.0, -0.25, 9000.0)


@query("g3_pixel_to_map", "SELECT pix_id, 1000 + 0.25::DOUBLE * (x + 0.5) AS mx, 9000 - 0.25::DOUBLE * (y + 0.5) AS my, CAST(x AS DOUBLE) + 0.5 AS px, CAST(y AS DOUBLE) + 0.5 AS py FROM v_pixels")
def g3_pixel_to_map(spark, sf):
    mx, my = _MAP.apply(F.col("x") + F.lit(0.5), F.col("y") + F.lit(0.5))
    p = view(spark, sf, "v_pixels").select("pix_id", mx.alias("mx"), my.alias("my"))
    px, py = _MAP.inverse().apply(F.col("mx"), F.col("my"))
    return p.select("*", px.alias("px"), py.alias("py"))


_C, _S = math.cos(math.radians(30)), math.sin(math.radians(30))
_TURN = f"""SELECT pix_id, tile_row, tile_col, tile_col * 20 + 10 + {_C!r}::DOUBLE * (x % 20 + 0.5 - 10) - {_S!r}::DOUBLE * (y % 20 + 0.5 - 10) AS sx, tile_row * 20 + 10 + {_S!r}::DOUBLE * (x % 20 + 0.5 - 10) + {_C!r}::DOUBLE * (y % 20 + 0.5 - 10) AS sy FROM v_pixels"""


def _turned(spark, sf):
    turn = P.rotated(P.Affine(1, 0, 0, 0, 1, 0), 20, 20, 30)
    lx, ly = turn.apply(F.col("x") % 20 + F.lit(0.5), F.col("y") % 20 + F.lit(0.5))
    return view(spark, sf, "v_pixels").select("pix_id", (lx + F.col("tile_col") * 20).alias("sx"), (ly + F.col("tile_row") * 20).alias("sy"))


@query("g4_rotated_tiles", f"SELECT pix_id, round(sx, 6) AS sx, round(sy, 6) AS sy FROM ({_TURN}) t")
def g4_rotated_tiles(spark, sf):
    return _turned(spark, sf).select("pix_id", F.round("sx", 6).alias("sx"), F.round("sy", 6).alias("sy"))


@query("g5_resample", f"""SELECT t.pix_id, round(sum(w * nir) / sum(CASE WHEN nir IS NOT NULL THEN w END), 3) AS nir FROM (SELECT pix_id, CAST(floor(sx - 0.5) AS INTEGER) + i AS qx, CAST(floor(sy - 0.5) AS INTEGER) + j AS qy,
 (CASE WHEN i = 1 THEN sx - 0.5 - floor(sx - 0.5) ELSE 1 - (sx - 0.5 - floor(sx - 0.5)) END) * (CASE WHEN j = 1 THEN sy - 0.5 - floor(sy - 0.5) ELSE 1 - (sy - 0.5 - floor(sy - 0.5)) END) AS w
 FROM ({_TURN}) a, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) n(i, j)) t LEFT JOIN v_pixels p ON p.x = qx AND p.y = qy GROUP BY t.pix_id""")
def g5_resample(spark, sf):
    return G.resample(_turned(spark, sf), view(spark, sf, "v_pixels"), ["nir"], ["pix_id"]).withColumn("nir", F.round("nir", 3))


@query("g7_mosaic_extent", "SELECT (max(tile_col) + 1) * 20 AS width, (max(tile_row) + 1) * 20 AS height FROM v_pixels")
def g7_mosaic_extent(spark, sf):
    size, overlap = 20, 0
    ends = lambda c: ((F.max(c) + 1) * size - F.max(c) * overlap)
    return view(spark, sf, "v_pixels").agg(ends("tile_col").alias("width"), ends("tile_row").alias("height"))


_OVER = """SELECT x, y, t.r AS tile_row, t.c AS tile_col, CASE WHEN nir > 15000 THEN 0 ELSE nir END AS nir FROM v_pixels, (SELECT r, c FROM range(8) a(c), range(400) b(r)) t WHERE x >= c * 28 AND x < c * 28 + 32 AND y >= r * 28 AND y < r * 28 + 32"""


@query("g8_g9_first_mosaic", f"SELECT x, y, arg_min(nir + tile_row * 100000 + tile_col * 10000000, (tile_row, tile_col)) AS nir FROM ({_OVER}) t GROUP BY x, y")
def g8_g9_first_mosaic(spark, sf):
    """Values over 15000 are 0; where tiles overlap the first stays (its tile is coded into the value to show which)."""
    tiles = G.assign_tiles(view(spark, sf, "v_pixels"), 32, 4).withColumn("nir", F.when(F.col("nir") > 15000, 0).otherwise(F.col("nir")))
    coded = tiles.withColumn("nir", F.col("nir") + F.col("tile_row").cast("long") * 100000 + F.col("tile_col").cast("long") * 10000000)
    return G.mosaic(coded, ["nir"], "first")


@query("g10_tile_names", "SELECT file_id, CAST(regexp_extract(name, 'tile_([0-9]+)_([0-9]+)', 1) AS INTEGER) AS tile_row, CAST(regexp_extract(name, 'tile_([0-9]+)_([0-9]+)', 2) AS INTEGER) AS tile_col, regexp_extract(name, '(small|mid|bigger)', 1) AS field FROM v_files")
def g10_tile_names(spark, sf):
    at = lambda i: F.regexp_extract("name", r"tile_(\d+)_(\d+)", i).cast("int")
    return view(spark, sf, "v_files").select("file_id", at(1).alias("tile_row"), at(2).alias("tile_col"), F.regexp_extract("name", "(small|mid|bigger)", 1).alias("field"))


def _series(base: str, coef, fun: str, sign: str) -> str:
    first, second = ("cos", "sinh") if fun == "x" else ("sin", "cosh")
    return base + "".join(f" {sign} {c!r}::DOUBLE * {first}({2 * j} * xi) * {second}({2 * j} * eta)" for j, c in enumerate(coef, 1))


_ATANH = "(0.5 * ln((1 + {0}) / (1 - {0})))"
_K = P.SCALE * P._A
_UTM = f"""SELECT fid, 500000 + {_K!r}::DOUBLE * ({_series('eta', P._ALPHA, 'x', '+')}) AS east, {_K!r}::DOUBLE * ({_series('xi', P._ALPHA, 'y', '+')}) AS north FROM (SELECT fid, atan2(t, cos(d)) AS xi, {_ATANH.format('(sin(d) / sqrt(1 + t * t))')} AS eta
 FROM (SELECT fid, radians(lon - 9) AS d, sinh({_ATANH.format('sin(radians(lat))')} - {P._E!r}::DOUBLE * {_ATANH.format(f'({P._E!r}::DOUBLE * sin(radians(lat)))')}) AS t FROM v_points) a) b"""


@query("g12_utm", f"SELECT v.fid, round(east, 4) AS east, round(north, 4) AS north, round(lon, 7) AS lon, round(lat, 7) AS lat FROM v_points v JOIN ({_UTM}) u ON u.fid = v.fid")
def g12_utm(spark, sf):
    east, north = P.to_utm(F.col("lon"), F.col("lat"))
    p = view(spark, sf, "v_points").select("fid", east.alias("east"), north.alias("north"))
    lon, lat = P.from_utm(F.col("east"), F.col("north"))
    return p.select("fid", F.round("east", 4).alias("east"), F.round("north", 4).alias("north"), F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


@query("g13_flips", " UNION ALL ".join(f"SELECT pix_id, '{k}' AS kind, {'19 - x % 20' if 'h' in k else 'x % 20'} AS x, {'19 - y % 20' if 'v' in k else 'y % 20'} AS y, nir FROM v_pixels" for k in ("h", "v", "hv")))
def g13_flips(spark, sf):
    kinds = []
    for k in ("h", "v", "hv"):
        x, y = P.flipped(F.col("x") % 20, F.col("y") % 20, k, 19, 19)
        kinds.append(F.struct(F.lit(k).alias("kind"), x.alias("x"), y.alias("y")))
    return view(spark, sf, "v_pixels").select("pix_id", "nir", F.explode(F.array(*kinds)).alias("f")).select("pix_id", "f.*", "nir")


@query("g14_rot90", "SELECT pred_id, miny - floor(miny / 10) * 10 AS minx, 10 - (maxx - floor(minx / 10) * 10) AS miny FROM v_pred")
def g14_rot90(spark, sf):
    far_x, near_y = F.col("maxx") - F.floor(F.col("minx") / 10) * 10, F.col("miny") - F.floor(F.col("miny") / 10) * 10
    x, y = P.rot90(far_x, near_y, 10.0)
    return view(spark, sf, "v_pred").select("pred_id", x.alias("minx"), y.alias("miny"))

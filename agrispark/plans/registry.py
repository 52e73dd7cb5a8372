"""All queries of the field-survey operators by name, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from agrispark.functions import spectral as S
from agrispark.operators import labels as L, models as M, normalize as N, segments as G, spatial as J
from agrispark.plans.fixtures import view
from agrispark.plans.register import ORACLE_SQL, QUERIES, query  # noqa: F401  the registry's interface

BANDS = ["red", "green", "blue", "ext_green", "ext_red", "rededge", "nir"]
IOU = """CASE WHEN least(a.maxx, b.maxx) > greatest(a.minx, b.minx) AND least(a.maxy, b.maxy) > greatest(a.miny, b.miny) THEN
 (least(a.maxx, b.maxx) - greatest(a.minx, b.minx)) * (least(a.maxy, b.maxy) - greatest(a.miny, b.miny)) /
 ((a.maxx - a.minx) * (a.maxy - a.miny) + (b.maxx - b.minx) * (b.maxy - b.miny) - (least(a.maxx, b.maxx) - greatest(a.minx, b.minx)) * (least(a.maxy, b.maxy) - greatest(a.miny, b.miny))) ELSE 0 END"""
RATIO = """CASE WHEN least(a.maxx, b.maxx) > greatest(a.minx, b.minx) AND least(a.maxy, b.maxy) > greatest(a.miny, b.miny) THEN
 (least(a.maxx, b.maxx) - greatest(a.minx, b.minx)) * (least(a.maxy, b.maxy) - greatest(a.miny, b.miny)) /
 least((a.maxx - a.minx) * (a.maxy - a.miny), (b.maxx - b.minx) * (b.maxy - b.miny)) ELSE 0 END"""


def _i(c: str) -> str:
    return f"CAST(floor({c}) AS INTEGER)"


# --- scans and spectral functions ------------------------------------------------------------------------------

@query("s1_scan_pixels", "SELECT pix_id, x, y, " + ", ".join(f"{b} / CAST(65535 AS DOUBLE) AS {b}" for b in BANDS) + " FROM v_pixels")
def s1_scan_pixels(spark, sf):
    return view(spark, sf, "v_pixels").select("pix_id", "x", "y", *((F.col(b) / F.lit(65535.0)).alias(b) for b in BANDS))


@query("v1_32_indices", "SELECT pix_id, " + ", ".join(f"round({S.formula_sql(n)}, 6) AS {n.lower()}" for n in S.FORMULAS) + " FROM v_pixels")
def v1_32_indices(spark, sf):
    return view(spark, sf, "v_pixels").select("pix_id", *(F.round(S.index(n), 6).alias(n.lower()) for n in S.FORMULAS))


@query(
    "v33_36_index_variants",
    f"""SELECT pix_id, round({S.formula_sql('NGRDI')}, 6) AS ngrdi_extended, round({S.formula_sql('NGRDI', 'red', 'green')}, 6) AS ngrdi_real,
 round(CASE WHEN green + red <> 0 THEN (green - red) / CAST(green + red AS DOUBLE) ELSE 0 END, 6) AS ngrdi_guarded,
 CASE WHEN alpha <> 0 THEN round({S.formula_sql('NDVI')}, 6) END AS ndvi_masked FROM v_pixels""",
)
def v33_36_index_variants(spark, sf):
    p = view(spark, sf, "v_pixels")
    g, r = F.col("green").cast("double"), F.col("red").cast("double")
    return p.select(
        "pix_id", F.round(S.index("NGRDI"), 6).alias("ngrdi_extended"), F.round(S.index("NGRDI", red="red", green="green"), 6).alias("ngrdi_real"),
        F.round(S.guarded_ratio(g, r), 6).alias("ngrdi_guarded"), S.masked(F.round(S.index("NDVI"), 6), F.col("alpha")).alias("ndvi_masked"),
    )


def _u16(n: str) -> str:
    lo, hi = S.RANGES.get(n, (-1.0, 1.0))
    return f"CAST(floor((least(greatest({S.formula_sql(n)}, CAST({lo} AS DOUBLE)), CAST({hi} AS DOUBLE)) - CAST({lo} AS DOUBLE)) / CAST({hi - lo} AS DOUBLE) * 65535) AS INTEGER)"


@query("s3_band_addresses", "SELECT pix_id, b.band, b.v FROM (SELECT pix_id, unnest([{'band': 7, 'v': nir}, " + ", ".join(f"{{'band': {i}, 'v': {_u16(n)}}}" for i, n in ((8, "NDVI"), (9, "SVI"), (10, "NGRDI"), (15, "CVI"))) + "]) AS b FROM v_pixels) t")
def s3_band_addresses(spark, sf):
    """A stack's bands and indices by the numbers that existing stacks give them."""
    names = ["NIR", "NDVI", "SVI", "NGRDI", "CVI"]
    value = {"NIR": F.col("nir")} | {n: S.scale_u16(S.index(n), n) for n in names[1:]}
    rows = [F.struct(F.lit(i).alias("band"), value[n].alias("v")) for n, i in zip(names, S.band_refs(names), strict=True)]
    return view(spark, sf, "v_pixels").select("pix_id", F.explode(F.array(*rows)).alias("b")).select("pix_id", "b.*")


@query("n1_scale_u16", f"SELECT pix_id, {_u16('NDVI')} AS ndvi, {_u16('NGRVI')} AS ngrvi, {_u16('EVI')} AS evi, round({_u16('NDVI')} / CAST(65535 AS DOUBLE) * 2 - 1, 6) AS ndvi_back FROM v_pixels")
def n1_scale_u16(spark, sf):
    u = lambda n: S.scale_u16(S.index(n), n)
    return view(spark, sf, "v_pixels").select("pix_id", u("NDVI").alias("ndvi"), u("NGRVI").alias("ngrvi"), u("EVI").alias("evi"), F.round(S.unscale_u16(u("NDVI"), "NDVI"), 6).alias("ndvi_back"))


@query("n2_minmax_tile", f"""SELECT pix_id, {_i('CASE WHEN hi > lo THEN (nir - lo) / CAST(hi - lo AS DOUBLE) * 255 ELSE 0 END')} AS nir_u8
 FROM (SELECT pix_id, nir, min(nir) OVER (PARTITION BY tile_row, tile_col) AS lo, max(nir) OVER (PARTITION BY tile_row, tile_col) AS hi FROM v_pixels) t""")
def n2_minmax_tile(spark, sf):
    return N.minmax_tile(view(spark, sf, "v_pixels"), "nir", "nir_u8").select("pix_id", "nir_u8")


_G3 = "(SELECT least(min(red), min(green), min(nir)) AS lo, greatest(max(red), max(green), max(nir)) AS hi FROM v_pixels)"


@query("n3_global_stretch", "SELECT pix_id, " + ", ".join(f"{_i(f'({b} - lo) / CAST(hi - lo AS DOUBLE) * 255')} AS {b}_u8" for b in ("red", "green", "nir")) + f" FROM v_pixels, {_G3} g")
def n3_global_stretch(spark, sf):
    return N.global_stretch(view(spark, sf, "v_pixels"), ["red", "green", "nir"]).select("pix_id", "red_u8", "green_u8", "nir_u8")


@query("n4_pct_stretch", f"""SELECT pix_id, {_i('(least(greatest(CAST(nir AS DOUBLE), a), b) - a) / (b - a) * 255')} AS nir_u8 FROM v_pixels,
 (SELECT quantile_cont(CAST(nir AS DOUBLE), 0.02) AS a, quantile_cont(CAST(nir AS DOUBLE), 0.98) AS b FROM v_pixels) q""")
def n4_pct_stretch(spark, sf):
    return N.pct_stretch(view(spark, sf, "v_pixels"), "nir", "nir_u8").select("pix_id", "nir_u8")


@query("n6_global_band_stats", " UNION ALL ".join(
    f"SELECT '{b}' AS band, round(avg(lo), 6) AS lo, round(avg(hi), 6) AS hi FROM (SELECT min(CASE WHEN {b} > 5000 THEN {b} END) AS lo, max(CASE WHEN {b} > 5000 THEN {b} END) AS hi FROM v_pixels GROUP BY tile_row, tile_col) t" for b in BANDS))
def n6_global_band_stats(spark, sf):
    return N.global_band_stats(view(spark, sf, "v_pixels"), BANDS, 5000).select("band", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query("n6_stats_fallback", " UNION ALL ".join(
    f"SELECT '{b}' AS band, round(coalesce(avg(lo), {N.FALLBACK[b][0]}), 6) AS lo, round(coalesce(avg(hi), {N.FALLBACK[b][1]}), 6) AS hi FROM (SELECT min(CASE WHEN {b} > 15000 AND {b} <> 16777 THEN {b} END) AS lo, max(CASE WHEN {b} > 15000 AND {b} <> 16777 THEN {b} END) AS hi FROM v_pixels GROUP BY tile_row, tile_col) t" for b in BANDS))
def n6_stats_fallback(spark, sf):
    """With a nodata value, and fixed ranges for bands that no tile has a value of."""
    stats = N.global_band_stats(view(spark, sf, "v_pixels"), BANDS, 15000, nodata=16777, fallback=N.FALLBACK)
    return stats.select("band", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query("n8_blend_stretch", """SELECT pix_id, round(least(greatest((nir - (0.1 * lo + 0.9 * glo)) / ((0.1 * hi + 0.9 * ghi) - (0.1 * lo + 0.9 * glo) + 1e-6), 0), 1), 6) AS nir_n
 FROM v_pixels JOIN (SELECT tile_row AS r, tile_col AS c, CAST(min(nir) AS DOUBLE) AS lo, CAST(max(nir) AS DOUBLE) AS hi FROM v_pixels GROUP BY 1, 2) t ON r = tile_row AND c = tile_col,
 (SELECT avg(CAST(l AS DOUBLE)) AS glo, avg(CAST(h AS DOUBLE)) AS ghi FROM (SELECT min(nir) AS l, max(nir) AS h FROM v_pixels GROUP BY tile_row, tile_col) q) g""")
def n8_blend_stretch(spark, sf):
    return N.blend_stretch(view(spark, sf, "v_pixels"), "nir", "nir_n").select("pix_id", F.round("nir_n", 6).alias("nir_n"))


@query("n12_band_ranges", " UNION ALL ".join(f"SELECT '{b}' AS band, min({b}) AS lo, max({b}) AS hi FROM v_pixels" for b in BANDS))
def n12_band_ranges(spark, sf):
    return N.band_ranges(view(spark, sf, "v_pixels"), BANDS)


# --- tiles and mosaics -----------------------------------------------------------------------------------------

@query("g1_tile_grid", """SELECT CAST(r AS INTEGER) AS tile_row, CAST(c AS INTEGER) AS tile_col, CAST(c * 28 AS INTEGER) AS x0, CAST(r * 28 AS INTEGER) AS y0,
 CAST(least(32, w - c * 28) AS INTEGER) AS w, CAST(least(32, h - r * 28) AS INTEGER) AS h FROM (SELECT max(x) + 1 AS w, max(y) + 1 AS h FROM v_pixels) s, range(100) a(c), range(2000) b(r)
 WHERE c < ceil((w - 4) / 28.0) AND r < ceil((h - 4) / 28.0) AND w > c * 28 AND h > r * 28""")
def g1_tile_grid(spark, sf):
    size = view(spark, sf, "v_pixels").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h")).first()
    return G.tile_grid(spark, size["w"], size["h"], 32, 4)


@query("g2_g6_split_and_merge", "SELECT x, y, red, nir FROM v_pixels")
def g2_g6_split_and_merge(spark, sf):
    return G.mosaic(G.assign_tiles(view(spark, sf, "v_pixels"), 32, 4), ["red", "nir"])


@query("g2_assign_tiles", """SELECT tile_row, tile_col, count(*) AS n FROM (SELECT CAST(r AS INTEGER) AS tile_row, CAST(c AS INTEGER) AS tile_col FROM v_pixels, range(8) a(c), range(400) b(r)
 WHERE x >= c * 28 AND x < c * 28 + 32 AND y >= r * 28 AND y < r * 28 + 32) t GROUP BY 1, 2""")
def g2_assign_tiles(spark, sf):
    return G.assign_tiles(view(spark, sf, "v_pixels"), 32, 4).groupBy("tile_row", "tile_col").agg(F.count(F.lit(1)).alias("n"))


@query("g11_covered_tiles", """SELECT tile_row, tile_col, round(avg(CASE WHEN alpha > 0 THEN 1.0 ELSE 0.0 END), 6) AS share FROM v_pixels GROUP BY 1, 2 HAVING avg(CASE WHEN alpha > 0 THEN 1.0 ELSE 0.0 END) >= 0.6""")
def g11_covered_tiles(spark, sf):
    return G.covered_tiles(view(spark, sf, "v_pixels"), 0.6).withColumn("share", F.round("share", 6))


@query("g11_nodata_tiles", """SELECT kind, tile_row, tile_col, round(avg(ok), 6) AS share FROM (SELECT tile_row, tile_col, 'nodata' AS kind, CASE WHEN alpha = 0 THEN 0.0 ELSE 1.0 END AS ok FROM v_pixels
 UNION ALL SELECT tile_row, tile_col, 'white', CASE WHEN alpha = 0 OR noise % 3 = 0 THEN 0.0 ELSE 1.0 END FROM v_pixels) t GROUP BY 1, 2, 3 HAVING avg(ok) >= 0.6""")
def g11_nodata_tiles(spark, sf):
    """Rasters without alpha: by a nodata value, and by white where there is none."""
    p = view(spark, sf, "v_pixels")
    marked = p.withColumn("red", F.when(F.col("alpha") == 0, 7).otherwise(F.col("red")))
    white = p.withColumn("red", F.when((F.col("alpha") == 0) | (F.col("noise") % 3 == 0), 65535).otherwise(F.col("red")))
    found = {"nodata": G.covered_tiles(marked, 0.6, alpha=None, nodata=7), "white": G.covered_tiles(white, 0.6, alpha=None)}
    both = [d.select(F.lit(k).alias("kind"), "tile_row", "tile_col", F.round("share", 6).alias("share")) for k, d in found.items()]
    return both[0].unionByName(both[1])


# --- masks, segments, texture ----------------------------------------------------------------------------------

_MASK = f"({_u16('NGRVI')} > 0.016 * 65535)"


def mask_pixels(pixels: DataFrame, name: str = "NGRVI") -> DataFrame:
    return pixels.where(S.scale_u16(S.index(name), name) > S.MASK_THRESHOLDS[name] * 65535)


@query("m1_threshold_masks", "SELECT " + ", ".join(f"CAST(sum(CASE WHEN {_u16(n)} > {t} * 65535 THEN 1 ELSE 0 END) AS BIGINT) AS {n.lower()}" for n, t in S.MASK_THRESHOLDS.items()) + ", tile_row, tile_col FROM v_pixels GROUP BY tile_row, tile_col")
def m1_threshold_masks(spark, sf):
    on = [F.sum(F.when(S.scale_u16(S.index(n), n) > t * 65535, 1).otherwise(0)).cast("long").alias(n.lower()) for n, t in S.MASK_THRESHOLDS.items()]
    return view(spark, sf, "v_pixels").groupBy("tile_row", "tile_col").agg(*on)


_U8 = "CAST(floor(nir / 65535.0 * 255) AS INTEGER)"


@query("m3_otsu", f"""SELECT tile_row, tile_col, arg_min(v, (-round(b, 3), v)) AS threshold FROM (SELECT tile_row, tile_col, v,
 CASE WHEN w > w0 THEN CAST(w0 AS DOUBLE) * (w - w0) * (s0 / CAST(w0 AS DOUBLE) - (s - s0) / CAST(w - w0 AS DOUBLE)) * (s0 / CAST(w0 AS DOUBLE) - (s - s0) / CAST(w - w0 AS DOUBLE)) ELSE 0 END AS b
 FROM (SELECT tile_row, tile_col, v, sum(n) OVER u AS w0, sum(n * v) OVER u AS s0, sum(n) OVER (PARTITION BY tile_row, tile_col) AS w, sum(n * v) OVER (PARTITION BY tile_row, tile_col) AS s
 FROM (SELECT tile_row, tile_col, {_U8} AS v, count(*) AS n FROM v_pixels GROUP BY 1, 2, 3) h WINDOW u AS (PARTITION BY tile_row, tile_col ORDER BY v)) r) q GROUP BY 1, 2""")
def m3_otsu(spark, sf):
    return N.otsu(view(spark, sf, "v_pixels").withColumn("v8", F.expr(_U8)), "v8")


@query("m4_erode_dilate", """SELECT a.pix_id, min(b.nir) AS eroded, max(b.nir) AS dilated FROM v_pixels a JOIN v_pixels b ON a.tile_row = b.tile_row AND a.tile_col = b.tile_col
 AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY a.pix_id""")
def m4_erode_dilate(spark, sf):
    p = N.morphology(view(spark, sf, "v_pixels"), "nir", "eroded", "erode")
    return N.morphology(p, "nir", "dilated", "dilate").select("pix_id", "eroded", "dilated")


@query("m5_apply_mask", f"SELECT pix_id, CASE WHEN {_MASK} THEN red ELSE 0 END AS red, CASE WHEN {_MASK} THEN nir ELSE 0 END AS nir FROM v_pixels")
def m5_apply_mask(spark, sf):
    on = S.scale_u16(S.index("NGRVI"), "NGRVI") > S.MASK_THRESHOLDS["NGRVI"] * 65535
    return view(spark, sf, "v_pixels").select("pix_id", *(F.when(on, F.col(b)).otherwise(0).alias(b) for b in ("red", "nir")))


_SEGS = f"""WITH RECURSIVE runs AS (SELECT tile_row, tile_col, y, min(pix_id) AS run, min(x) AS x0, max(x) AS x1 FROM (SELECT tile_row, tile_col, y, x, pix_id,
 x - row_number() OVER (PARTITION BY tile_row, tile_col, y ORDER BY x) AS g FROM v_pixels WHERE {_MASK}) t GROUP BY tile_row, tile_col, y, g),
 edges AS (SELECT a.run AS u, b.run AS v FROM runs a JOIN runs b ON a.tile_row = b.tile_row AND a.tile_col = b.tile_col AND abs(a.y - b.y) = 1 AND a.x0 <= b.x1 + 1 AND b.x0 <= a.x1 + 1),
 reach AS (SELECT run, run AS low FROM runs UNION SELECT e.v, r.low FROM reach r JOIN edges e ON e.u = r.run),
 comp AS (SELECT run, min(low) AS seg_id FROM reach GROUP BY run),
 segs AS (SELECT tile_row, tile_col, seg_id, min(x0) AS x, min(y) AS y, max(x1) - min(x0) + 1 AS w, max(y) - min(y) + 1 AS h, CAST(sum(x1 - x0 + 1) AS BIGINT) AS n_px FROM runs JOIN comp USING (run) GROUP BY 1, 2, 3) """


@query("m7_segments", _SEGS + "SELECT * FROM segs")
def m7_segments(spark, sf):
    return G.segments(mask_pixels(view(spark, sf, "v_pixels")))


@query("m16_vi_detector", _SEGS + """SELECT tile_row, tile_col, seg_id, (x % 20 + w / 2.0) / 20 AS cx, (y % 20 + h / 2.0) / 20 AS cy, w / 20.0 AS bw, h / 20.0 AS bh FROM segs WHERE w * h BETWEEN 40 AND 200""")
def m16_vi_detector(spark, sf):
    return G.segment_labels(G.filter_area(m7_segments(spark, sf), 40, 200), 20)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Plants per tile that the plain index detector finds."""
    return m16_vi_detector(spark, sf).groupBy("tile_row", "tile_col").agg(F.count(F.lit(1)).alias("plants"))


_OBJ = """WITH o AS (SELECT tile_row * 1000 + tile_col AS obj, x, y, CAST(floor((nir - min(nir) OVER w) / CAST(max(nir) OVER w - min(nir) OVER w AS DOUBLE) * 15) AS INTEGER) AS v FROM v_pixels WHERE blob = 1
 WINDOW w AS (PARTITION BY tile_row, tile_col)), """
_PAIRS = _OBJ + """d AS (SELECT * FROM (VALUES (0, 1, 0), (45, 1, -1), (90, 0, 1), (135, 1, 1)) t(angle, dx, dy)),
 p AS (SELECT a.obj, angle, a.v AS i, b.v AS j FROM o a, d, o b WHERE b.obj = a.obj AND b.x = a.x + dx AND b.y = a.y + dy),
 s AS (SELECT obj, angle, i, j FROM p UNION ALL SELECT obj, angle, j, i FROM p),
 g AS (SELECT obj, angle, i, j, count(*) / CAST(sum(count(*)) OVER (PARTITION BY obj, angle) AS DOUBLE) AS p FROM s GROUP BY obj, angle, i, j) """


def _objects(spark, sf):
    p = view(spark, sf, "v_pixels").where("blob = 1")
    stats = p.groupBy("tile_row", "tile_col").agg(F.min("nir").alias("lo"), F.max("nir").alias("hi"))
    v = F.floor((F.col("nir") - F.col("lo")) / (F.col("hi") - F.col("lo")).cast("double") * 15).cast("int")
    return p.join(stats, ["tile_row", "tile_col"]).select((F.col("tile_row") * 1000 + F.col("tile_col")).alias("obj"), "x", "y", v.alias("v"))


@query("f2_glcm", _PAIRS + "SELECT obj, angle, i, j, round(p, 9) AS p FROM g")
def f2_glcm(spark, sf):
    return G.glcm(_objects(spark, sf)).withColumn("p", F.round("p", 9))


@query("f3_glcm_props", _PAIRS + """, m AS (SELECT obj, angle, sum(i * p) AS mu FROM g GROUP BY 1, 2),
 e AS (SELECT g.obj, g.angle, sum(p * (i - j) * (i - j)) AS contrast, sum(p * p) AS asm, sum(p * (i - mu) * (i - mu)) AS variance, sum(p / (1 + (i - j) * (i - j))) AS homogeneity, sum(-p * ln(p)) AS entropy
 FROM g JOIN m ON g.obj = m.obj AND g.angle = m.angle GROUP BY 1, 2)
 SELECT obj, round(avg(contrast), 6) AS contrast, round(avg(asm), 6) AS asm, round(avg(variance), 6) AS variance, round(avg(homogeneity), 6) AS homogeneity, round(avg(entropy), 6) AS entropy, round(avg(sqrt(asm)), 6) AS energy FROM e GROUP BY obj""")
def f3_glcm_props(spark, sf):
    names = ["contrast", "asm", "variance", "homogeneity", "entropy", "energy"]
    return G.glcm_props(G.glcm(_objects(spark, sf))).select("obj", *(F.round(n, 6).alias(n) for n in names))


# --- boxes -----------------------------------------------------------------------------------------------------

@query("j1_j2_overlaps", f"SELECT a.pred_id AS a_id, b.pred_id AS b_id, round({RATIO}, 6) AS ratio FROM v_pred a JOIN v_pred b ON a.pred_id < b.pred_id AND {RATIO} >= 0.1")
def j1_j2_overlaps(spark, sf):
    p = view(spark, sf, "v_pred")
    pairs = J.box_pairs(p, p).where("pred_id < b_pred_id").where(J.overlap_ratio() >= 0.1)
    return pairs.select(F.col("pred_id").alias("a_id"), F.col("b_pred_id").alias("b_id"), F.round(J.overlap_ratio(), 6).alias("ratio"))


_BEST = f"(SELECT a.pred_id, arg_max(b.gt_id, ({IOU}, -b.gt_id)) AS gt_id, max({IOU}) AS iou FROM v_pred a JOIN v_gt b ON {IOU} > 0 GROUP BY 1)"


@query("j5_best_match", f"SELECT p.pred_id, gt_id, round(iou, 6) AS iou FROM v_pred p LEFT JOIN {_BEST} m ON m.pred_id = p.pred_id")
def j5_best_match(spark, sf):
    return J.best_match(view(spark, sf, "v_pred"), view(spark, sf, "v_gt")).withColumn("iou", F.round("iou", 6))


@query("a2_a3_confusion", f"""WITH c AS (SELECT CAST(sum(CASE WHEN iou >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS tp, count(DISTINCT CASE WHEN iou >= 0.5 THEN gt_id END) AS met FROM {_BEST} b),
 d AS (SELECT tp, (SELECT count(*) FROM v_pred) - tp AS fp, (SELECT count(*) FROM v_gt) - met AS fn FROM c)
 SELECT tp, fp, fn, round(tp / CAST(tp + fp AS DOUBLE), 4) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 4) AS recall, round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 4) AS f1, round(tp / CAST(tp + fp + fn AS DOUBLE), 4) AS accuracy FROM d""")
def a2_a3_confusion(spark, sf):
    return J.scores(J.confusion(view(spark, sf, "v_pred"), view(spark, sf, "v_gt")))


@query("a1_confusion_by_tile", f"""WITH m AS (SELECT p.tile_row, p.tile_col, p.pred_id, b.gt_id FROM v_pred p LEFT JOIN (SELECT * FROM {_BEST} x WHERE iou >= 0.5) b ON b.pred_id = p.pred_id),
 t AS (SELECT tile_row, tile_col, count(gt_id) AS tp, count(*) - count(gt_id) AS fp FROM m GROUP BY 1, 2),
 g AS (SELECT tile_row, tile_col, count(*) AS n_gt FROM v_gt GROUP BY 1, 2)
 SELECT coalesce(t.tile_row, g.tile_row) AS tile_row, coalesce(t.tile_col, g.tile_col) AS tile_col, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(n_gt, 0) AS n_gt FROM t FULL OUTER JOIN g ON t.tile_row = g.tile_row AND t.tile_col = g.tile_col""")
def a1_confusion_by_tile(spark, sf):
    p, g = view(spark, sf, "v_pred"), view(spark, sf, "v_gt")
    hit = J.best_match(p, g).where("iou >= 0.5").select("pred_id", "gt_id")
    t = p.join(hit, "pred_id", "left").groupBy("tile_row", "tile_col").agg(F.count("gt_id").alias("tp"), (F.count(F.lit(1)) - F.count("gt_id")).alias("fp"))
    n = g.groupBy("tile_row", "tile_col").agg(F.count(F.lit(1)).alias("n_gt"))
    return t.join(n, ["tile_row", "tile_col"], "full_outer").na.fill(0, ["tp", "fp", "n_gt"])


_D = "sqrt(power(greatest(b.minx - a.maxx, a.minx - b.maxx, 0), 2) + power(greatest(b.miny - a.maxy, a.miny - b.maxy, 0), 2))"


@query("j7_nearest", f"SELECT p.pred_id, m.gt_id, round(m.d, 6) AS dist FROM v_pred p LEFT JOIN (SELECT pred_id, gt_id, d FROM (SELECT a.pred_id, b.gt_id, {_D} AS d, min({_D}) OVER (PARTITION BY a.pred_id) AS low FROM v_pred a JOIN v_gt b ON {_D} <= 0.25) t WHERE d = low) m ON m.pred_id = p.pred_id")
def j7_nearest(spark, sf):
    near = J.nearest(view(spark, sf, "v_pred"), view(spark, sf, "v_gt"), 0.25, "pred_id")
    return near.select("pred_id", F.col("b_gt_id").alias("gt_id"), F.round("dist", 6).alias("dist"))


@query("j9_merge_boxes", f"""WITH RECURSIVE e AS (SELECT a.pred_id AS u, b.pred_id AS v FROM v_pred a JOIN v_pred b ON a.pred_id <> b.pred_id AND {RATIO} >= 0.4),
 reach AS (SELECT pred_id AS n, pred_id AS low FROM v_pred UNION SELECT e.v, r.low FROM reach r JOIN e ON e.u = r.n),
 comp AS (SELECT n, min(low) AS group_id FROM reach GROUP BY n)
 SELECT group_id, count(*) AS n, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy, max(conf) AS conf, arg_min(class_id, pred_id) AS class_id FROM v_pred JOIN comp ON comp.n = pred_id GROUP BY group_id""")
def j9_merge_boxes(spark, sf):
    return J.merge_boxes(view(spark, sf, "v_pred"), "pred_id", 0.4)


@query("j9_merge_greedy")
def j9_merge_greedy(spark, sf):
    """As j9_merge_boxes, with groups grown in order."""
    return J.merge_greedy(view(spark, sf, "v_pred"), "pred_id", 0.1)


@query("j12_area_filter", "SELECT pred_id, round((maxx - minx) * (maxy - miny), 6) AS area FROM v_pred WHERE (maxx - minx) * (maxy - miny) BETWEEN 0.2 AND 0.41")
def j12_area_filter(spark, sf):
    area = (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))
    return view(spark, sf, "v_pred").where(area.between(0.2, 0.41)).select("pred_id", F.round(area, 6).alias("area"))


@query("j22_dedup_geometry", "SELECT pred_id, minx, miny, maxx, maxy, conf FROM (SELECT *, row_number() OVER (PARTITION BY floor(minx * 8), floor(miny * 8) ORDER BY conf DESC, pred_id) AS r FROM v_pred) t WHERE r = 1")
def j22_dedup_geometry(spark, sf):
    key = [F.floor(F.col("minx") * 8).alias("kx"), F.floor(F.col("miny") * 8).alias("ky")]
    row = F.struct("pred_id", "minx", "miny", "maxx", "maxy", "conf")
    return view(spark, sf, "v_pred").groupBy(*key).agg(F.max_by(row, F.struct("conf", -F.col("pred_id"))).alias("r")).select("r.*")


# --- fusion and evaluation -------------------------------------------------------------------------------------

@query("u1_normalise_scores", """SELECT pred_id, round((margin - lo) / (hi - lo + 1e-9), 6) AS minmax, round(1 / (1 + exp(-margin / sd)), 6) AS sigmoid, round((below + (ties + 1) / 2.0) / n, 6) AS rank
 FROM (SELECT pred_id, margin, rank() OVER (ORDER BY margin) - 1 AS below, count(*) OVER (PARTITION BY margin) AS ties, count(*) OVER () AS n FROM v_pred) p, (SELECT min(margin) AS lo, max(margin) AS hi, stddev_samp(margin) AS sd FROM v_pred) s""")
def u1_normalise_scores(spark, sf):
    p = view(spark, sf, "v_pred").select("pred_id", "margin")
    for m in ("minmax", "sigmoid", "rank"):
        p = J.normalised(p, "margin", m, m)
    return p.select("pred_id", *(F.round(m, 6).alias(m) for m in ("minmax", "sigmoid", "rank")))


@query("u2_fusion_rules", """SELECT pred_id, round(0.5 * y + 0.5 * s, 6) AS weighted_sum, round(y * s, 6) AS product, round(least(y, s), 6) AS and_min, round(greatest(y, s), 6) AS or_max,
 round(CASE WHEN y + s > 0 THEN 2 * y * s / (y + s) ELSE 0 END, 6) AS harmonic, round(y, 6) AS yolo_only, round(s, 6) AS svm_only
 FROM (SELECT pred_id, coalesce(conf, 0) AS y, coalesce(CASE WHEN margin > 0 THEN margin / 6 END, 0) AS s FROM v_pred) t""")
def u2_fusion_rules(spark, sf):
    s = F.when(F.col("margin") > 0, F.col("margin") / 6)
    rules = ["weighted_sum", "product", "and_min", "or_max", "harmonic", "yolo_only", "svm_only"]
    return view(spark, sf, "v_pred").select("pred_id", *(F.round(J.fuse(F.col("conf"), s, r), 6).alias(r) for r in rules))


_TRUTH = f"(SELECT p.pred_id, p.conf AS score, CASE WHEN b.iou >= 0.5 THEN 1 ELSE 0 END AS truth FROM v_pred p LEFT JOIN {_BEST} b ON b.pred_id = p.pred_id)"


def _scored(spark, sf):
    p = view(spark, sf, "v_pred")
    m = J.best_match(p, view(spark, sf, "v_gt"))
    return p.join(m, "pred_id").select("pred_id", F.col("conf").alias("score"), F.when(F.col("iou") >= 0.5, 1).otherwise(0).alias("truth"))


@query("a5_roc_points", f"""SELECT score, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS fp FROM (SELECT score, sum(truth) AS p, sum(1 - truth) AS n FROM {_TRUTH} t GROUP BY score) q
 WINDOW w AS (ORDER BY score DESC)""")
def a5_roc_points(spark, sf):
    return J.roc_points(_scored(spark, sf)).select("score", "tp", "fp")


@query("a6_youden", f"""SELECT arg_max(score, (round(j, 9), score)) AS threshold, round(max(j), 6) AS j FROM (SELECT score, sum(p) OVER w / CAST(sum(p) OVER () AS DOUBLE) - sum(n) OVER w / CAST(sum(n) OVER () AS DOUBLE) AS j
 FROM (SELECT score, sum(truth) AS p, sum(1 - truth) AS n FROM {_TRUTH} t GROUP BY score) q WINDOW w AS (ORDER BY score DESC)) z""")
def a6_youden(spark, sf):
    return J.youden(J.roc_points(_scored(spark, sf)))


@query("a13_stage_times", "SELECT round(avg(pre_ms), 6) AS pre_ms, round(avg(infer_ms), 6) AS infer_ms, round(avg(post_ms), 6) AS post_ms, round(1000 / avg(pre_ms + infer_ms + post_ms), 6) AS fps FROM (SELECT CAST(pre_ms AS DOUBLE) AS pre_ms, CAST(infer_ms AS DOUBLE) AS infer_ms, CAST(post_ms AS DOUBLE) AS post_ms FROM v_times) t")
def a13_stage_times(spark, sf):
    t = view(spark, sf, "v_times").select(*(F.col(c).cast("double").alias(c) for c in ("pre_ms", "infer_ms", "post_ms")))
    return t.agg(*(F.round(F.avg(c), 6).alias(c) for c in t.columns), F.round(1000 / F.avg(F.col("pre_ms") + F.col("infer_ms") + F.col("post_ms")), 6).alias("fps"))


# --- labels ----------------------------------------------------------------------------------------------------

_TOK = """(SELECT *, CASE len(t) WHEN 0 THEN 'blank' WHEN 5 THEN 'box' WHEN 6 THEN 'box_conf' WHEN 9 THEN 'quad' WHEN 10 THEN 'quad_conf' ELSE 'bad' END AS layout
 FROM (SELECT *, list_filter(string_split(line, ' '), lambda x: x <> '') AS t FROM v_label_lines) q)"""


@query("s4_parse_labels", f"""SELECT split, stem, line_no, layout, CASE WHEN layout NOT IN ('blank', 'bad') THEN CAST(t[1] AS INTEGER) END AS class_id, CASE WHEN layout IN ('box_conf', 'quad_conf') THEN CAST(t[2] AS DOUBLE) END AS conf,
 CASE WHEN layout IN ('box', 'quad') THEN CAST(t[2] AS DOUBLE) WHEN layout IN ('box_conf', 'quad_conf') THEN CAST(t[3] AS DOUBLE) END AS c1 FROM {_TOK} z""")
def s4_parse_labels(spark, sf):
    return L.parse_labels(view(spark, sf, "v_label_lines")).select("split", "stem", "line_no", "layout", "class_id", "conf", F.get("coords", F.lit(0)).alias("c1"))


@query("a10_instance_counts", f"""SELECT split, count(DISTINCT stem) AS files, CAST(sum(CASE WHEN layout NOT IN ('blank', 'bad') THEN 1 ELSE 0 END) AS BIGINT) AS objects,
 CAST(sum(CASE WHEN layout NOT IN ('blank', 'bad') AND t[1] = '0' THEN 1 ELSE 0 END) AS BIGINT) AS class_0, CAST(sum(CASE WHEN layout = 'bad' THEN 1 ELSE 0 END) AS BIGINT) AS malformed FROM {_TOK} z GROUP BY split""")
def a10_instance_counts(spark, sf):
    p = L.parse_labels(view(spark, sf, "v_label_lines"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return p.groupBy("split").agg(
        F.countDistinct("stem").alias("files"), n(F.col("class_id").isNotNull()).alias("objects"), n(F.col("class_id") == 0).alias("class_0"), n(F.col("layout") == "bad").alias("malformed")
    )


@query("a11_split_shares", "SELECT split, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM v_label_lines GROUP BY split")
def a11_split_shares(spark, sf):
    by = view(spark, sf, "v_label_lines").groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


_BOUNDS = f"""(SELECT *, CASE WHEN layout = 'box' THEN 0 WHEN layout = 'box_conf' THEN 1 WHEN layout = 'quad' THEN 2 WHEN layout = 'quad_conf' THEN 3 END AS k,
 list_transform(CASE WHEN layout IN ('box', 'quad') THEN t[2:] WHEN layout IN ('box_conf', 'quad_conf') THEN t[3:] ELSE [] END, lambda x: CAST(x AS DOUBLE)) AS c FROM {_TOK} y WHERE layout NOT IN ('blank', 'bad'))"""


@query("j17_labels_to_map", f"""SELECT line_no, round((col + CASE WHEN k < 2 THEN c[1] - c[3] / 2 ELSE least(c[1], c[3], c[5], c[7]) END) * 10, 6) AS map_minx, round((row_ + 1 - CASE WHEN k < 2 THEN c[2] - c[4] / 2 ELSE least(c[2], c[4], c[6], c[8]) END) * 10, 6) AS map_maxy
 FROM (SELECT *, CAST(regexp_extract(stem, 'tile_([0-9]+)_([0-9]+)', 1) AS INTEGER) AS row_, CAST(regexp_extract(stem, 'tile_([0-9]+)_([0-9]+)', 2) AS INTEGER) AS col FROM {_BOUNDS} b) z""")
def j17_labels_to_map(spark, sf):
    m = L.to_map(L.bounds(L.parse_labels(view(spark, sf, "v_label_lines"))))
    return m.select("line_no", F.round("map_minx", 6).alias("map_minx"), F.round("map_maxy", 6).alias("map_maxy"))


@query("l3_canonical_stems", "SELECT file_id, lower(trim(replace(replace(replace(string_split(name, '.rf.')[1], '_NEN', ''), '_png', ''), '_jpg', ''))) AS stem FROM v_files")
def l3_canonical_stems(spark, sf):
    return view(spark, sf, "v_files").select("file_id", L.canonical_stem(F.col("name")).alias("stem"))


@query("l9_split", """SELECT stem, CASE WHEN r <= floor(n * 0.7 + 1e-9) THEN 'train' WHEN r <= floor(n * 0.9 + 1e-9) THEN 'val' ELSE 'test' END AS split
 FROM (SELECT stem, row_number() OVER (ORDER BY md5('42:' || stem), stem) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT stem FROM v_label_lines) d) t""")
def l9_split(spark, sf):
    return L.split_dataset(view(spark, sf, "v_label_lines"))


@query("s9_confusion_round_trip", ORACLE_SQL["a2_a3_confusion"].rpartition("SELECT tp, fp, fn,")[0] + "SELECT tp, fp, fn FROM d")
def s9_confusion_round_trip(spark, sf):
    return L.confusion_from_lines(L.confusion_lines(a2_a3_confusion(spark, sf)))


ORACLE_SQL["s9_confusion_round_trip"] = ORACLE_SQL["a2_a3_confusion"].rpartition("SELECT tp, fp, fn,")[0] + "SELECT tp, fp, fn FROM d"


# --- detectors, search, routes ---------------------------------------------------------------------------------

@query("o1_standard_scaler", """SELECT pix_id, round((nir - m) / s, 6) AS nir, round((red - rm) / rs, 6) AS red FROM v_pixels, (SELECT avg(nir) AS m, stddev_pop(nir) AS s, avg(red) AS rm, stddev_pop(red) AS rs FROM v_pixels) t""")
def o1_standard_scaler(spark, sf):
    p = view(spark, sf, "v_pixels")
    s = p.agg(F.avg("nir").alias("m"), F.stddev_pop("nir").alias("s"), F.avg("red").alias("rm"), F.stddev_pop("red").alias("rs"))
    return p.crossJoin(F.broadcast(s)).select("pix_id", F.round((F.col("nir") - F.col("m")) / F.col("s"), 6).alias("nir"), F.round((F.col("red") - F.col("rm")) / F.col("rs"), 6).alias("red"))  # one row


@query("o4_mahalanobis", """SELECT pix_id, round(sqrt(greatest((dx * dx * cyy - 2 * dx * dy * cxy + dy * dy * cxx) / (cxx * cyy - cxy * cxy), 0)), 5) AS dist FROM (SELECT pix_id, nir - mx AS dx, ext_red - my AS dy, cxx, cyy, cxy FROM v_pixels,
 (SELECT avg(nir) AS mx, avg(ext_red) AS my, var_pop(nir) AS cxx, var_pop(ext_red) AS cyy, covar_pop(nir, ext_red) AS cxy FROM v_pixels) s) t""")
def o4_mahalanobis(spark, sf):
    p = view(spark, sf, "v_pixels")
    cols = ["nir", "ext_red"]
    return p.select("pix_id", F.round(M.mahalanobis(cols, *M.moments(p, cols)), 5).alias("dist"))


@query("f11_similar", """SELECT query_id, desc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, desc_id) AS rank FROM (SELECT q.desc_id AS query_id, b.desc_id,
 round(list_dot_product(q.vec, b.vec) / (sqrt(list_dot_product(q.vec, q.vec)) * sqrt(list_dot_product(b.vec, b.vec)) + 1e-12), 9) AS score FROM v_desc q JOIN v_desc b ON q.desc_id % 20 = 0 AND q.desc_id <> b.desc_id) t) z WHERE rank <= 5""")
def f11_similar(spark, sf):
    d = view(spark, sf, "v_desc")
    return M.similar(d.where("desc_id % 20 = 0"), d)


@query("f13_mean_similarity", """SELECT a.desc_id, round(avg(list_dot_product(a.vec, b.vec) / (sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(b.vec, b.vec)))), 6) AS mean_sim FROM v_desc a JOIN v_desc b ON a.desc_id <> b.desc_id GROUP BY 1""")
def f13_mean_similarity(spark, sf):
    return M.mean_similarity(view(spark, sf, "v_desc")).withColumn("mean_sim", F.round("mean_sim", 6))


_MEAN_DISTANCE = "SELECT a.desc_id, avg(list_distance(a.vec, b.vec)) AS d FROM v_desc a JOIN v_desc b ON a.desc_id <> b.desc_id GROUP BY 1"


@query("f13_mean_distance", f"SELECT desc_id, round(d, 6) AS mean_dist FROM ({_MEAN_DISTANCE}) t")
def f13_mean_distance(spark, sf):
    return M.mean_distance(view(spark, sf, "v_desc")).withColumn("mean_dist", F.round("mean_dist", 6))


@query("f13_outliers_euclidean", f"SELECT desc_id, round(d, 6) AS score FROM ({_MEAN_DISTANCE}) t WHERE d > 1.41")
def f13_outliers_euclidean(spark, sf):
    return M.outliers(view(spark, sf, "v_desc"), 1.41, "euclidean").withColumn("score", F.round("score", 6))


@query("r3_r6_zone_routes")
def r3_r6_zone_routes(spark, sf):
    return M.zone_routes(view(spark, sf, "v_points"))


_STITCHED = """WITH RECURSIVE r AS (SELECT zone, row_number() OVER (PARTITION BY zone ORDER BY fid) - 1 AS seq, fid, x, y FROM v_points),
 e AS (SELECT zone, count(*) AS n, (min(x) + max(x)) / 2 AS mx, (min(y) + max(y)) / 2 AS my, arg_min(x, seq) AS ax, arg_min(y, seq) AS ay, arg_max(x, seq) AS bx, arg_max(y, seq) AS by_ FROM r GROUP BY zone),
 w AS (SELECT *, floor((my - min(my) OVER ()) / 8) AS row_ FROM e),
 o AS (SELECT *, row_number() OVER s AS place, sum(n) OVER s - n AS first FROM w WINDOW s AS (ORDER BY row_, CASE WHEN row_ % 2 = 0 THEN mx ELSE -mx END, zone)),
 d AS (SELECT place, 0::DOUBLE AS f, 0::DOUBLE AS b, 'f' AS pf, 'b' AS pb, ax, ay, bx, by_ FROM o WHERE place = 1
  UNION ALL SELECT place, least(ff, bf), least(fb, bb), CASE WHEN bf < ff THEN pb ELSE pf END || 'f', CASE WHEN bb < fb THEN pb ELSE pf END || 'b', ax, ay, bx, by_ FROM (
   SELECT o.place, pf, pb, o.ax, o.ay, o.bx, o.by_, f + sqrt(power(d.bx - o.ax, 2) + power(d.by_ - o.ay, 2)) AS ff, b + sqrt(power(d.ax - o.ax, 2) + power(d.ay - o.ay, 2)) AS bf,
    f + sqrt(power(d.bx - o.bx, 2) + power(d.by_ - o.by_, 2)) AS fb, b + sqrt(power(d.ax - o.bx, 2) + power(d.ay - o.by_, 2)) AS bb FROM d JOIN o ON o.place = d.place + 1) z),
 best AS (SELECT CASE WHEN b < f THEN pb ELSE pf END AS ways FROM d ORDER BY place DESC LIMIT 1),
 s AS (SELECT CAST(first + CASE WHEN ways[CAST(place AS INT)] = 'b' THEN n - 1 - seq ELSE seq END AS BIGINT) AS seq, r.zone, fid, x, y FROM r JOIN o ON o.zone = r.zone, best)"""


def routes_by_id(spark, sf):
    """The points of each zone in the order of their ids, as given routes."""
    place = F.row_number().over(Window.partitionBy("zone").orderBy("fid")) - 1
    return view(spark, sf, "v_points").select("zone", place.cast("long").alias("seq"), "fid", "x", "y")


@query("r6_stitched", f"{_STITCHED} SELECT seq, zone, fid, x, y FROM s")
def r6_stitched(spark, sf):
    return M.stitched(routes_by_id(spark, sf), 8.0)


@query("r6_line", f"{_STITCHED} SELECT count(*) AS n_points, round(sum(sqrt(power(x - px, 2) + power(y - py, 2))), 4) AS length FROM (SELECT x, y, lag(x) OVER (ORDER BY seq) AS px, lag(y) OVER (ORDER BY seq) AS py FROM s) t")
def r6_line(spark, sf):
    return M.route_line(M.stitched(routes_by_id(spark, sf), 8.0)).withColumn("length", F.round("length", 4))


@query("r6_field_route")
def r6_field_route(spark, sf):
    """Short routes of all zones, stitched into one."""
    return M.stitched(M.zone_routes(view(spark, sf, "v_points")), 8.0)


@query("r1_route_length", """SELECT zone, count(*) AS n_points, round(coalesce(sum(sqrt(power(x - px, 2) + power(y - py, 2))), 0), 6) AS length FROM (SELECT zone, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py FROM v_points WINDOW w AS (PARTITION BY zone ORDER BY fid)) t GROUP BY zone""")
def r1_route_length(spark, sf):
    return M.route_length(view(spark, sf, "v_points").withColumn("seq", F.col("fid"))).withColumn("length", F.round("length", 6))


from agrispark.plans import detections, exports, features, files, learning, rasters  # noqa: E402,F401  register more queries

"""Queries on label files, file names, dataset splits, streams and neighbour graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from agrispark.operators import labels as L, models as M, segments as G, spatial as J
from agrispark.operators.detectors import Plain
from agrispark.plans.fixtures import view
from agrispark.plans.register import query
from agrispark.plans.registry import _MASK, _STITCHED, _TOK, mask_pixels, routes_by_id
from agrispark.session import scratch
from agrispark.sources import files as S
from agrispark.streaming import labels as T, segments as Z, tables as W


def _folder(spark) -> str:
    return scratch(spark, "files")


# --- sources and sinks -----------------------------------------------------------------------------------------

@query("s5_label_files", "SELECT split, line FROM v_label_lines")
def s5_label_files(spark, sf):
    """Lines written as text files, a folder for each split, and read back."""
    path = _folder(spark)
    S.write_labels(view(spark, sf, "v_label_lines"), path, ["split"])
    return S.read_labels(spark, path).select("split", "line")


@query("s5_quad_lines", """SELECT pred_id, concat_ws(' ', CAST(class_id AS VARCHAR), printf('%.6f', conf), printf('%.6f', minx), printf('%.6f', miny), printf('%.6f', maxx), printf('%.6f', miny), printf('%.6f', maxx), printf('%.6f', maxy), printf('%.6f', minx), printf('%.6f', maxy)) AS line FROM v_pred""")
def s5_quad_lines(spark, sf):
    ring = [(F.col(x), F.col(y)) for x, y in (("minx", "miny"), ("maxx", "miny"), ("maxx", "maxy"), ("minx", "maxy"))]
    return view(spark, sf, "v_pred").select("pred_id", L.quad_line(F.col("class_id"), ring, F.col("conf")).alias("line"))


@query("s7_geojson", """SELECT gt_id, tile, area FROM (SELECT gt_id, concat('tile_', tile_row, '_', tile_col) AS tile, (maxx - minx) AS area FROM v_gt) t""")
def s7_geojson(spark, sf):
    """Features are read back as JSON: their tile, and the length of their first side."""
    f = L.geojson(view(spark, sf, "v_gt"), "gt_id")
    at = lambda p: F.get_json_object("feature", p)
    side = at("$.geometry.coordinates[0][1][0]").cast("double") - at("$.geometry.coordinates[0][0][0]").cast("double")
    return f.select("gt_id", at("$.properties.tile").alias("tile"), side.alias("area"))


@query("s10_runs", "SELECT CAST(line_no % 3 AS INTEGER) AS run, count(*) AS n, CAST(3 AS INTEGER) AS next_run FROM v_label_lines GROUP BY 1")
def s10_runs(spark, sf):
    path = _folder(spark)
    lines = view(spark, sf, "v_label_lines")
    for r in range(3):  # three runs, each written by its own job
        S.write_labels(lines.where(F.col("line_no") % 3 == r), f"{path}/run{r}")
    runs = S.read_runs(spark, path)
    return runs.groupBy("run").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(S.next_run(runs).select(F.col("run").alias("next_run"))))  # one row


@query("s12_pending", "SELECT file_id FROM v_files WHERE name NOT IN (SELECT name FROM v_files WHERE file_id % 4 = 1)")
def s12_pending(spark, sf):
    f = view(spark, sf, "v_files")
    return L.pending(f, f.where("file_id % 4 = 1"), "name").select("file_id")


@query("s8_route_csv")
def s8_route_csv(spark, sf):
    path = _folder(spark)
    S.write_route(M.zone_routes(view(spark, sf, "v_points")), path)
    return spark.read.option("header", True).schema("sequence long, orig_fid long, x double, y double").csv(path)


@query("s8_stitched_csv", f"{_STITCHED} SELECT seq AS sequence, fid AS orig_fid, x, y FROM s")
def s8_stitched_csv(spark, sf):
    """Given routes of all zones, stitched, written as CSV and read back."""
    path = _folder(spark)
    S.write_route(M.stitched(routes_by_id(spark, sf), 8.0), path)
    return spark.read.option("header", True).schema("sequence long, orig_fid long, x double, y double").csv(path)


# --- names and datasets ----------------------------------------------------------------------------------------

@query("l1_collapse_classes", "SELECT line_no, '0' || substr(line, strpos(line, ' ')) AS line FROM v_label_lines WHERE trim(line) <> ''")
def l1_collapse_classes(spark, sf):
    return L.collapse_classes(view(spark, sf, "v_label_lines")).select("line_no", "line")


@query("l2_prefixed", "SELECT file_id, CASE WHEN name LIKE '%small%' THEN name ELSE 'small_' || name END AS name FROM v_files")
def l2_prefixed(spark, sf):
    return view(spark, sf, "v_files").select("file_id", L.prefixed(F.col("name"), "small").alias("name"))


@query("l4_field_names", r"SELECT file_id, CASE WHEN name LIKE '%\_obb\_%' ESCAPE '\' THEN regexp_extract(name, '^(.+)_(bigger|mid|small)_obb', 1) || '_' || regexp_extract(name, '_(bigger|mid|small)_obb', 1) || '_' || regexp_extract(name, 'tile_[0-9]+_[0-9]+') || right(name, 4) ELSE name END AS name FROM v_files")
def l4_field_names(spark, sf):
    return view(spark, sf, "v_files").select("file_id", L.field_name(F.col("name")).alias("name"))


@query("l5_cut_stems", "SELECT file_id, string_split(name, '_NEN')[1] AS stem, array_to_string(string_split(name, '_')[1:3], '_') AS head FROM v_files")
def l5_cut_stems(spark, sf):
    return view(spark, sf, "v_files").select("file_id", L.cut_stem(F.col("name")).alias("stem"), L.cut_stem(F.col("name"), ("_none",)).alias("head"))


_STEM = "lower(trim(replace(replace(replace(string_split(name, '.rf.')[1], '_NEN', ''), '_png', ''), '_jpg', '')))"


@query("l6_pairs", f"SELECT a.stem, image, label FROM (SELECT {_STEM} AS stem, name AS image FROM v_files WHERE name LIKE '%.jpg') a JOIN (SELECT {_STEM} AS stem, name AS label FROM v_files) b ON a.stem = b.stem")
def l6_pairs(spark, sf):
    f = view(spark, sf, "v_files")
    return L.paired(f.where(F.col("name").endswith(".jpg")), f, L.canonical_stem)


@query("l7_replaced", f"""SELECT count(*) AS files, CAST(sum(CASE WHEN n IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS replaced, CAST(sum(CASE WHEN n IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing, max(coalesce(n, name)) AS last_name
 FROM (SELECT {_STEM} AS stem, name FROM v_files) a LEFT JOIN (SELECT {_STEM} AS stem, min('new_' || name) AS n FROM v_files WHERE file_id % 3 = 0 GROUP BY 1) b ON b.stem = a.stem""")
def l7_replaced(spark, sf):
    f = view(spark, sf, "v_files").select("file_id", L.canonical_stem(F.col("name")).alias("stem"), "name")
    out = L.replaced(f, f.where("file_id % 3 = 0").withColumn("name", F.concat(F.lit("new_"), "name")))
    return out.agg(F.count(F.lit(1)).alias("files"), F.count_if("found").alias("replaced"), F.count_if(~F.col("found")).alias("missing"), F.max("name").alias("last_name"))


@query("l8_combined", "SELECT file_id, 'a' AS dataset, 'a_' || name AS name FROM (SELECT file_id, replace(name, 'a', 'o') AS name FROM v_files WHERE file_id % 2 = 0) x UNION ALL SELECT file_id, 'zz', 'zz_' || name FROM v_files WHERE file_id % 2 = 1")
def l8_combined(spark, sf):
    f = view(spark, sf, "v_files")
    return L.combined({"a": f.where("file_id % 2 = 0").withColumn("name", F.replace("name", F.lit("a"), F.lit("o"))), "zz": f.where("file_id % 2 = 1")})


@query("l10_split_shares", """SELECT shares, split, count(*) AS n FROM (SELECT shares, CASE WHEN r <= floor(n * t + 1e-9) THEN 'train' WHEN r <= floor(n * (t + v) + 1e-9) THEN 'val' ELSE 'test' END AS split
 FROM (SELECT row_number() OVER (ORDER BY md5('42:' || name), name) AS r, count(*) OVER () AS n FROM v_files) f, (VALUES ('70/20/10', 0.7::DOUBLE, 0.2::DOUBLE), ('85/10/5', 0.85::DOUBLE, 0.1::DOUBLE), ('70/15/15', 0.7::DOUBLE, 0.15::DOUBLE), ('80/10/10', 0.8::DOUBLE, 0.1::DOUBLE)) s(shares, t, v)) z GROUP BY 1, 2""")
def l10_split_shares(spark, sf):
    stems = view(spark, sf, "v_files").select(F.col("name").alias("stem"))
    out = None
    for name, shares in {"70/20/10": (0.7, 0.2), "85/10/5": (0.85, 0.1), "70/15/15": (0.7, 0.15), "80/10/10": (0.8, 0.1)}.items():
        one = L.split_dataset(stems, shares).groupBy("split").agg(F.count(F.lit(1)).alias("n")).withColumn("shares", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("l11_l12_field_split", "SELECT line_no, CASE WHEN stem LIKE '%large%' THEN 'train' WHEN stem LIKE '%mid%' THEN 'val' ELSE 'test' END AS split FROM v_label_lines")
def l11_l12_field_split(spark, sf):
    """The split by field of the stems, saved and put on all lines."""
    lines = view(spark, sf, "v_label_lines")
    split = lines.select("stem").distinct().withColumn("split", L.split_by_field(F.col("stem")))
    return L.apply_split(lines.drop("split"), split).select("line_no", "split")


@query("l13_descriptor", f"SELECT 'data/images/train' AS train, count(*) AS nc, array_to_string(list('class_' || c ORDER BY c), ',') AS names FROM (SELECT DISTINCT CAST(t[1] AS INTEGER) AS c FROM {_TOK} z WHERE layout NOT IN ('bad', 'blank')) q")
def l13_descriptor(spark, sf):
    seen = L.parse_labels(view(spark, sf, "v_label_lines")).where("class_id is not null").select("class_id", F.concat(F.lit("class_"), F.col("class_id").cast("string")).alias("class_name"))
    return L.descriptor(seen.distinct(), "data").select("train", F.col("nc").cast("long").alias("nc"), F.concat_ws(",", "names").alias("names"))


@query("l14_numbered", "SELECT file_id, left(name, length(name) - 4) || '_' || (row_number() OVER (PARTITION BY file_id % 40 ORDER BY file_id) - 1) || right(name, 4) AS name FROM v_files")
def l14_numbered(spark, sf):
    return L.numbered(view(spark, sf, "v_files").withColumn("g", F.col("file_id") % 40), "g", "file_id").select("file_id", "name")


# --- streams ---------------------------------------------------------------------------------------------------

@query("t1_label_stream", f"""SELECT layout, class_id, count(*) AS n, round(avg(conf), 6) AS mean_conf FROM (SELECT layout, CASE WHEN layout NOT IN ('blank', 'bad') THEN CAST(t[1] AS INTEGER) END AS class_id, CASE WHEN layout IN ('box_conf', 'quad_conf') THEN CAST(t[2] AS DOUBLE) END AS conf FROM {_TOK} z) q GROUP BY 1, 2""")
def t1_label_stream(spark, sf):
    """The label lines as a stream of files; after all of them its counts are those of the table."""
    path = _folder(spark)
    S.write_labels(view(spark, sf, "v_label_lines").repartition(4), path)
    counts = T.class_counts(T.label_stream(spark, path, 2))
    return T.drained(counts, _folder(spark), _folder(spark)).withColumn("mean_conf", F.round("mean_conf", 6))


@query("t2_scored_stream", f"SELECT line, round(conf * 2 - 1, 6) AS margin FROM (SELECT line, CAST(t[2] AS DOUBLE) AS conf FROM {_TOK} z WHERE layout IN ('box_conf', 'quad_conf')) q WHERE conf >= 0.5")
def t2_scored_stream(spark, sf):
    path = _folder(spark)
    S.write_labels(view(spark, sf, "v_label_lines").repartition(4), path)
    scored = T.scored_stream(T.label_stream(spark, path, 2), lambda d: d.where("conf >= 0.5").select("line", F.round(F.col("conf") * 2 - 1, 6).alias("margin")))
    return T.drained(scored, _folder(spark), _folder(spark), "append").select("line", "margin")


@query("t1_tile_stream", f"""SELECT r AS tile_row, c AS tile_col, count(*) AS n, count(conf) AS n_conf, round(avg(conf), 6) AS mean_conf FROM (SELECT CAST(regexp_extract(stem, 'tile_([0-9]+)_([0-9]+)', 1) AS INTEGER) AS r, CAST(regexp_extract(stem, 'tile_([0-9]+)_([0-9]+)', 2) AS INTEGER) AS c,
 CASE WHEN layout IN ('box_conf', 'quad_conf') THEN CAST(t[2] AS DOUBLE) END AS conf FROM {_TOK} z WHERE layout NOT IN ('bad', 'blank')) q GROUP BY 1, 2""")
def t1_tile_stream(spark, sf):
    """Label files named after their tiles, as a stream whose running counts by tile are merged into a table batch by batch."""
    path = _folder(spark)
    lines = view(spark, sf, "v_label_lines")
    S.write_labels(lines.repartition(8, "stem"), path, ["stem"])  # a folder for each stem
    n = lines.agg(F.countDistinct("stem")).first()[0]
    files = T.label_stream(spark, path, max(40, -(-n // 16)))  # a batch costs time of its own, so many files come in larger ones
    named = files.withColumn("file", F.regexp_extract("file", "stem=([^/]*)", 1))
    counts = W.merged(T.tile_counts(named), ["tile_row", "tile_col"], _folder(spark), _folder(spark), fold_every=4)
    return counts.withColumn("mean_conf", F.round("mean_conf", 6))


_FEATURES = f"(SELECT min(pix_id) AS seg_id, tile_row, tile_col, avg(nir) AS nir, avg(ext_red) AS ext_red FROM v_pixels WHERE {_MASK} GROUP BY tile_row, tile_col) f"


@query("t2_segment_stream", f"""SELECT seg_id, tile_row, tile_col, round(d, 5) AS mahal_dist, round(d, 5) <= 1.5 AS is_inlier, field FROM (SELECT seg_id, tile_row, tile_col, CASE tile_col % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'mid' ELSE 'large' END AS field,
 sqrt(greatest((power(nir - mx, 2) * cyy - 2 * (nir - mx) * (ext_red - my) * cxy + power(ext_red - my, 2) * cxx) / (cxx * cyy - cxy * cxy), 0)) AS d
 FROM {_FEATURES}, (SELECT avg(nir) AS mx, avg(ext_red) AS my, var_pop(nir) AS cxx, var_pop(ext_red) AS cyy, covar_pop(nir, ext_red) AS cxy FROM {_FEATURES}) s) t""")
def t2_segment_stream(spark, sf):
    """Mask segments that arrive as files of mean bands, scored by a detector fitted before, with the field of their tile."""
    px = view(spark, sf, "v_pixels")
    segs = G.segment_pixels(mask_pixels(px)).groupBy("seg_id", "tile_row", "tile_col").agg(F.avg("nir").alias("nir"), F.avg("ext_red").alias("ext_red"))
    path = _folder(spark)
    segs.repartition(6, "seg_id").write.parquet(path)
    detector = Plain(["nir", "ext_red"]).fit(spark.read.parquet(path))
    field = F.expr("CASE tile_col % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'mid' ELSE 'large' END").alias("field")
    tiles = px.select("tile_row", "tile_col", field).distinct()
    scored = Z.scored_segments(Z.segment_stream(spark, path, segs.schema, 2), detector, -1.500005, tiles)
    out = T.drained(scored, _folder(spark), _folder(spark), "append")
    return out.select("seg_id", "tile_row", "tile_col", F.round(-F.col("score"), 5).alias("mahal_dist"), "is_inlier", "field")


# --- neighbour graph -------------------------------------------------------------------------------------------

@query("r2_neighbour_graph", """SELECT a, b, rank FROM (SELECT p.gt_id AS a, q.gt_id AS b, row_number() OVER (PARTITION BY p.gt_id ORDER BY power((q.minx + q.maxx - p.minx - p.maxx) / 2, 2) + power((q.miny + q.maxy - p.miny - p.maxy) / 2, 2), q.gt_id) AS rank
 FROM v_gt p JOIN v_gt q ON q.gt_id <> p.gt_id AND abs(q.miny - p.miny) < 8) t WHERE rank <= 4""")
def r2_neighbour_graph(spark, sf):
    centres = view(spark, sf, "v_gt").select("gt_id", ((F.col("minx") + F.col("maxx")) / 2).alias("x"), ((F.col("miny") + F.col("maxy")) / 2).alias("y"))
    g = J.neighbour_graph(centres, "gt_id", 4, 2.0)
    return g.select(F.col("gt_id").alias("a"), F.col("other").alias("b"), "rank")

"""Queries on exported bands and scales, settings, and tables and records that are written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from agrispark.functions import spectral as S
from agrispark.operators import composites as C, features as T, learning as E, spatial as J
from agrispark.plans.features import lbp_sql
from agrispark.plans.files import _folder
from agrispark.plans.fixtures import view
from agrispark.plans.learning import _words
from agrispark.plans.rasters import _stack_sql
from agrispark.plans.register import ORACLE_SQL, half_up, query
from agrispark.plans.registry import RATIO
from agrispark.sources import files as Z

BOX = ["minx", "miny", "maxx", "maxy"]


@query("s6_detection_table", "SELECT pred_id, class_id, conf, minx, miny, maxx, maxy FROM v_pred")
def s6_detection_table(spark, sf):
    """A layer written twice to one place, the second time in full, and read back."""
    path, pred = _folder(spark), view(spark, sf, "v_pred")
    Z.write_detections(pred.where("conf >= 0.5"), path)
    Z.write_detections(pred, path)
    return Z.read_detections(spark, path)


@query("s13_run_parameters", "SELECT 'NDVI' AS index_name, 0.82::DOUBLE AS threshold, true AS masked, count(*) AS pixels, count(DISTINCT (tile_row, tile_col)) AS tiles FROM v_pixels")
def s13_run_parameters(spark, sf):
    """The settings of a run and the size of its input, written beside the output and read back."""
    path = _folder(spark)
    n = view(spark, sf, "v_pixels").agg(F.count(F.lit(1)).alias("pixels"), F.countDistinct("tile_row", "tile_col").alias("tiles")).first()
    Z.write_parameters(spark, {"index_name": "NDVI", "threshold": S.MASK_THRESHOLDS["NDVI"], "masked": True, "pixels": n["pixels"], "tiles": n["tiles"]}, path)
    return Z.read_parameters(spark, path, "index_name string, threshold double, masked boolean, pixels long, tiles long")


@query("g15_exported_bands", _stack_sql(["nir", "green", "red"], ["c1", "c2", "c3"]))
def g15_exported_bands(spark, sf):
    return C.exported(view(spark, sf, "v_pixels"), ["red", "green", "nir"]).select("pix_id", "c1", "c2", "c3")


_NGRDI = S.formula_sql("NGRDI")
_NGRDI_SHARE = f"(least(greatest({_NGRDI}, -1), 1) + 1) / (2 + 0.000001::DOUBLE)"


@query("n1c_scale_u8", f"SELECT pix_id, CASE WHEN alpha = 0 OR noise % 11 = 0 THEN 0 ELSE CAST(floor({_NGRDI_SHARE} * 255) AS INTEGER) END AS v FROM v_pixels")
def n1c_scale_u8(spark, sf):
    """An index with nulls where alpha is 0 and NaN at some places."""
    v = F.when(F.col("noise") % 11 == 0, F.lit(float("nan"))).otherwise(S.index("NGRDI"))
    return view(spark, sf, "v_pixels").select("pix_id", S.scale_u8(S.masked(v, F.col("alpha")), "NGRDI").alias("v"))


@query("n1d_scale_u16", f"SELECT pix_id, CAST(floor({_NGRDI_SHARE} * 65535) AS INTEGER) AS v FROM v_pixels")
def n1d_scale_u16(spark, sf):
    return view(spark, sf, "v_pixels").select("pix_id", S.scale_u16(S.index("NGRDI"), "NGRDI", 1e-6).alias("v"))


SETTING = "ndvi, SAVI,RVI , cire"


@query("v37_configured_indices", "SELECT pix_id, " + ", ".join(f"round({S.formula_sql(n)}, 6) AS {n.lower()}" for n in S.configured(SETTING)) + " FROM v_pixels")
def v37_configured_indices(spark, sf):
    names = S.configured(SETTING)
    return S.indices(view(spark, sf, "v_pixels"), names).select("pix_id", *(F.round(n.lower(), 6).alias(n.lower()) for n in names))


@query("f14_feature_table")
def f14_feature_table(spark, sf):
    """Histograms of some images, then of all, appended to one table: images that are in it already aren't added again."""
    path, h = _folder(spark), E.tfidf(_words(spark, sf))
    Z.append_histograms(h.where("image_id % 2 = 0"), path)
    Z.append_histograms(h, path)
    return spark.read.parquet(path).select("image_id", "word", F.round("weight", 6).alias("weight"))


ORACLE_SQL["f14_feature_table"] = ORACLE_SQL["f10_tfidf"]


@query("x3_confidence_rules", f"""WITH RECURSIVE e AS (SELECT a.pred_id AS u, b.pred_id AS v FROM v_pred a JOIN v_pred b ON a.pred_id <> b.pred_id AND {RATIO} >= 0.4),
 reach AS (SELECT pred_id AS n, pred_id AS low FROM v_pred UNION SELECT e.v, r.low FROM reach r JOIN e ON e.u = r.n), comp AS (SELECT n, min(low) AS group_id FROM reach GROUP BY n)
 SELECT group_id, max(conf) AS most, min(conf) AS least, round(avg(conf), 6) AS mean FROM v_pred JOIN comp ON comp.n = pred_id GROUP BY group_id""")
def x3_confidence_rules(spark, sf):
    pred = view(spark, sf, "v_pred")
    merged = J.merge_boxes(pred, "pred_id", 0.4, confidence={"most": "max", "least": "min", "mean": "avg"})
    return merged.select("group_id", "most", "least", half_up("mean", 6).alias("mean"))


@query("x4_feature_parameters", lbp_sql("red", 2, 12))
def x4_feature_parameters(spark, sf):
    """Binary patterns of another band, radius and number of points."""
    p = view(spark, sf, "v_pixels")
    o = p.select((F.col("tile_row") * 1000 + F.col("tile_col")).alias("obj"), "x", "y", F.floor(F.col("red") / 64).cast("int").alias("v"))
    stats = T.pattern_stats(T.local_patterns(o, 2, 12))
    return stats.select("obj", *(half_up(n, 6).alias(n) for n in ("lbp_mean", "lbp_var", "lbp_energy", "lbp_entropy")))

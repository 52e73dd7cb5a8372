"""Queries on one-class detectors, components and visual words."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, functions as F

from agrispark.operators import detectors as D, learning as E, models as M
from agrispark.operators.ranges import exact_percentiles
from agrispark.plans.fixtures import view
from agrispark.plans.register import ORACLE_SQL, query, rounded
from agrispark.plans.registry import f11_similar
from agrispark.session import stored

COLS = ["nir", "ext_red"]
_MAHAL = """(SELECT pix_id, sqrt(greatest((dx * dx * cyy - 2 * dx * dy * cxy + dy * dy * cxx) / (cxx * cyy - cxy * cxy), 0)) AS dist FROM (SELECT pix_id, nir - mx AS dx, ext_red - my AS dy, cxx, cyy, cxy FROM v_pixels,
 (SELECT avg(nir) AS mx, avg(ext_red) AS my, var_pop(nir) AS cxx, var_pop(ext_red) AS cyy, covar_pop(nir, ext_red) AS cxy FROM v_pixels) s) t)"""


def _distances(spark, sf):
    p = view(spark, sf, "v_pixels")
    return p.select("pix_id", F.round(M.mahalanobis(COLS, *M.moments(p, COLS)), 5).alias("dist"))


@query("o2_o14_scree")
def o2_o14_scree(spark, sf):
    return E.scree(view(spark, sf, "v_pixels"), ["nir", "red", "ext_red", "rededge"])


_LW = """WITH s AS (SELECT avg(nir) AS mx, avg(ext_red) AS my, var_pop(nir) AS a, var_pop(ext_red) AS b, covar_pop(nir, ext_red) AS c, count(*) AS n FROM v_pixels),
 q AS (SELECT mx, my, a, b, c, (a + b) / 2 AS mu, (power((a - b) / 2, 2) * 2 + 2 * c * c) / 2 AS delta,
  ((SELECT avg(power(power(nir - mx, 2) + power(ext_red - my, 2), 2)) FROM v_pixels, s) - (a * a + b * b + 2 * c * c)) / (2 * n) AS beta FROM s),
 r AS (SELECT *, CASE WHEN delta = 0 THEN 0 ELSE greatest(least(delta, beta), 0) / delta END AS k FROM q),
 t AS (SELECT mx, my, (1 - k) * a + k * mu AS a, (1 - k) * b + k * mu AS b, (1 - k) * c AS c FROM r)
 SELECT pix_id, round(sqrt(greatest((dx * dx * b - 2 * dx * dy * c + dy * dy * a) / (a * b - c * c), 0)), 5) AS dist FROM (SELECT pix_id, nir - mx AS dx, ext_red - my AS dy, a, b, c FROM v_pixels, t) z"""


@query("o2_principal_pair", """WITH s AS (SELECT avg(nir) AS mx, avg(ext_red) AS my, var_pop(nir) AS a, var_pop(ext_red) AS b, covar_pop(nir, ext_red) AS c FROM v_pixels),
 e AS (SELECT *, (a + b) / 2 + sqrt(power((a - b) / 2, 2) + c * c) AS l1, (a + b) / 2 - sqrt(power((a - b) / 2, 2) + c * c) AS l2 FROM s)
 SELECT pix_id, round(power((nir - mx) * c + (ext_red - my) * (l1 - a), 2) / (c * c + power(l1 - a, 2)) / l1, 6) AS first, round(l1 / (l1 + l2), 6) AS share FROM v_pixels, e""")
def o2_principal_pair(spark, sf):
    """Two bands on their first component, squared and in units of its variance, with the component's share."""
    p = view(spark, sf, "v_pixels")
    mean, components, shares = E.principal(p, COLS, 0.0)
    _, cov = M.moments(p, COLS)
    size = float(components[0] @ cov @ components[0])
    first = E.projected(COLS, mean, components)[0]
    return p.select("pix_id", F.round(first * first / size, 6).alias("first"), F.round(F.lit(float(shares[0])), 6).alias("share"))


@query("o3_ledoit_wolf", _LW)
def o3_ledoit_wolf(spark, sf):
    """Distances under the shrunk covariance."""
    p = view(spark, sf, "v_pixels")
    mean, cov = M.moments(p, COLS)
    shrunk, _ = M.ledoit_wolf(p, COLS, mean, cov)
    return p.select("pix_id", F.round(M.mahalanobis(COLS, mean, shrunk), 5).alias("dist"))


@query("o5_thresholds", f"SELECT pct, round(quantile_cont(d, pct / 100), 4) AS threshold, round(min(d), 4) AS lo, round(avg(d), 4) AS mean, round(max(d), 4) AS hi FROM (SELECT round(dist, 5) AS d FROM {_MAHAL} m) a, (VALUES (95.0::DOUBLE), (97.5::DOUBLE), (99.0::DOUBLE), (100.0::DOUBLE)) p(pct) GROUP BY pct".replace("quantile_cont(d, pct / 100)", "CASE pct WHEN 95 THEN quantile_cont(d, 0.95) WHEN 97.5 THEN quantile_cont(d, 0.975) WHEN 99 THEN quantile_cont(d, 0.99) ELSE max(d) END"))
def o5_thresholds(spark, sf):
    return E.thresholds(stored(_distances(spark, sf).select("dist")), "dist").select("pct", *(F.round(c, 4).alias(c) for c in ("threshold", "lo", "mean", "hi")))


@query("o6_o11_inliers", f"SELECT pix_id, round(dist, 5) AS mahal_dist, round(dist, 5) <= 2.5 AS is_inlier FROM {_MAHAL} m")
def o6_o11_inliers(spark, sf):
    return _distances(spark, sf).select("pix_id", F.col("dist").alias("mahal_dist"), (F.col("dist") <= 2.5).alias("is_inlier"))


@query("o15_ecdf", f"SELECT value, round(sum(n) OVER (ORDER BY value) / CAST(sum(n) OVER () AS DOUBLE), 6) AS share FROM (SELECT round(dist, 2) AS value, count(*) AS n FROM (SELECT round(dist, 5) AS dist FROM {_MAHAL} m) d GROUP BY 1) t")
def o15_ecdf(spark, sf):
    return E.ecdf(_distances(spark, sf).withColumn("dist", F.round("dist", 2)), "dist").withColumn("share", F.round("share", 6))


@query("o16_score_histogram", f"SELECT CASE WHEN d >= 4 THEN 21 ELSE CAST(floor(d / 4 * 20) AS INTEGER) + 1 END AS bin, d <= 2.5 AS inlier, count(*) AS n FROM (SELECT round(dist, 5) AS d FROM {_MAHAL} m) t GROUP BY 1, 2")
def o16_score_histogram(spark, sf):
    return E.score_histogram(_distances(spark, sf), "dist", 0.0, 4.0, 20, F.col("dist") <= 2.5)


@query("a14_scored_summary", f"SELECT count(*) AS n, CAST(sum(CASE WHEN d <= 2.5 THEN 1 ELSE 0 END) AS BIGINT) AS inliers, min(d) AS lo, max(d) AS hi FROM (SELECT round(dist, 5) AS d FROM {_MAHAL} m) t")
def a14_scored_summary(spark, sf):
    return _distances(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("dist") <= 2.5).alias("inliers"), F.min("dist").alias("lo"), F.max("dist").alias("hi"))


@query("o7_mixture")
def o7_mixture(spark, sf):
    """Log densities under a mixture of three; the lowest 5 % are outliers."""
    p = view(spark, sf, "v_pixels")
    model, _ = E.fit_mixture(p, COLS)
    s = stored(p.select("pix_id", E.mixture_score(model, COLS).alias("score")))  # several passes read it
    cut = exact_percentiles(s, "score", [0.05])[0]
    return s.select("pix_id", "score", (F.col("score") >= F.lit(cut)).alias("is_inlier"))


@query("o8_bic_sweep")
def o8_bic_sweep(spark, sf):
    return E.bic_sweep(view(spark, sf, "v_pixels"), COLS)


@query("o9_isolation_forest")
def o9_isolation_forest(spark, sf):
    p = view(spark, sf, "v_pixels")
    forest, size = E.fit_forest(p, COLS, "pix_id")
    return E.forest_scores(p, COLS, "pix_id", forest, size)


@query("o9_forest_inliers")
def o9_forest_inliers(spark, sf):
    """All pixels with their score, and whether it reaches the score under which 1 % of the training rows lie."""
    p = view(spark, sf, "v_pixels").select("pix_id", *COLS)
    forest = D.Forest(COLS, "pix_id").fit(p)
    cut = D.cut_at(forest, p, 0.01)
    return forest.score(p).select("pix_id", "score", (F.col("score") >= cut).alias("is_inlier"))


@query("o10_one_class_exact")
def o10_one_class_exact(spark, sf):
    """Scores of the exact machine at nu 0.001."""
    p = view(spark, sf, "v_pixels").select("pix_id", *COLS)
    out = D.ExactOneClass(COLS, "pix_id").fit(p).score(p)
    return out.select("pix_id", "score", (F.col("score") >= 0).alias("is_inlier"))


@query("o12_nu_sweep_exact")
def o12_nu_sweep_exact(spark, sf):
    """``nu, inliers``: the share that exact machines of rising nu accept, in one pass for all."""
    p = view(spark, sf, "v_pixels").select("pix_id", *COLS)
    nus = (0.001, 0.01, 0.05, 0.1, 0.2)
    parts = [E.one_class_exact_scores(p, COLS, "pix_id", E.fit_one_class_exact(p, COLS, "pix_id", nu, 1000)).select(F.lit(nu).alias("nu"), "score") for nu in nus]
    both = reduce(DataFrame.unionByName, parts)
    return both.groupBy("nu").agg(F.avg((F.col("score") >= 0).cast("double")).alias("inliers"))


@query("o10_one_class")
def o10_one_class(spark, sf):
    p = view(spark, sf, "v_pixels")
    model = E.fit_one_class(p, COLS)
    return p.select("pix_id", E.one_class_score(COLS, model).alias("score"))


@query("o12_nu_sweep")
def o12_nu_sweep(spark, sf):
    """``nu, inliers``: the share that each machine accepts."""
    p = view(spark, sf, "v_pixels")
    out = None
    for nu in (0.05, 0.2):
        score = E.one_class_score(COLS, E.fit_one_class(p, COLS, nu, steps=20))
        one = p.agg(F.avg((score >= 0).cast("double")).alias("inliers")).withColumn("nu", F.lit(nu))
        out = one if out is None else out.unionByName(one)
    return out


_MOVED = """(SELECT pix_id, nir, ext_red, coalesce(lag(nir) OVER w, nir) AS m_nir, coalesce(lag(ext_red) OVER w, ext_red) AS m_ext_red FROM v_pixels
 WINDOW w AS (PARTITION BY left(md5('42:' || pix_id), 2) ORDER BY md5('42:' || pix_id), pix_id))"""
_DIST = lambda x, y: f"sqrt(greatest((power({x} - mx, 2) * cyy - 2 * ({x} - mx) * ({y} - my) * cxy + power({y} - my, 2) * cxx) / (cxx * cyy - cxy * cxy), 0))"
_STATS = "(SELECT avg(nir) AS mx, avg(ext_red) AS my, var_pop(nir) AS cxx, var_pop(ext_red) AS cyy, covar_pop(nir, ext_red) AS cxy FROM v_pixels) s"


@query("o13_permutation_importance", f"""SELECT unnest(['nir', 'ext_red']) AS feature, unnest([a, b]) AS "drop" FROM (SELECT round(avg({_DIST('m_nir', 'ext_red')} - {_DIST('nir', 'ext_red')}), 6) AS a, round(avg({_DIST('nir', 'm_ext_red')} - {_DIST('nir', 'ext_red')}), 6) AS b
 FROM {_MOVED} m, {_STATS}) z""")
def o13_permutation_importance(spark, sf):
    p = view(spark, sf, "v_pixels")
    drop = E.permutation_importance(p, COLS, -M.mahalanobis(COLS, *M.moments(p, COLS)), "pix_id")
    return drop.withColumn("drop", F.round("drop", 6))


# --- visual words ----------------------------------------------------------------------------------------------

_WORDS = "(SELECT d.image_id, d.desc_id, arg_min(w.desc_id, (round(list_sum(list_transform(range(1, 65), lambda i: power(d.vec[i] - w.vec[i], 2))), 9), w.desc_id)) AS word FROM v_desc d, v_desc w WHERE w.desc_id < 8 GROUP BY 1, 2)"


def _words(spark, sf):
    """The first eight descriptors are the vocabulary, so that SQL can follow."""
    d = view(spark, sf, "v_desc")
    centres = np.array([r.vec for r in d.where("desc_id < 8").orderBy("desc_id").collect()])  # eight rows
    return d.select("image_id", "desc_id", E.nearest_word(F.col("vec"), centres).alias("word"))


@query("f9_nearest_words", f"SELECT image_id, desc_id, word FROM {_WORDS} w")
def f9_nearest_words(spark, sf):
    return _words(spark, sf)


@query("f10_tfidf", f"""WITH a AS (SELECT * FROM {_WORDS} w), tf AS (SELECT image_id, word, count(*) AS n FROM a GROUP BY 1, 2), t AS (SELECT image_id, count(*) AS t FROM a GROUP BY 1), df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1),
 raw AS (SELECT tf.image_id, tf.word, n / (t + 1e-6) * ln((SELECT count(*) FROM t) / CAST(df + 1 AS DOUBLE)) AS w FROM tf JOIN t ON t.image_id = tf.image_id JOIN df ON df.word = tf.word)
 SELECT image_id, word, round(w / s, 6) AS weight FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY image_id)) AS s FROM raw) z WHERE s > 0 AND w <> 0""")
def f10_tfidf(spark, sf):
    return E.tfidf(_words(spark, sf)).withColumn("weight", F.round("weight", 6))


@query("f8_vocabulary")
def f8_vocabulary(spark, sf):
    """Histograms of all images over a vocabulary trained on all descriptors."""
    d = view(spark, sf, "v_desc")
    return E.tfidf(d.select("image_id", E.nearest_word(F.col("vec"), E.vocabulary(d, 16)).alias("word")))


@query("f11_histogram_metrics", """SELECT q.desc_id AS query_id, b.desc_id, round(list_sum(list_transform(range(1, 65), lambda i: power(abs(q.vec[i]) - abs(b.vec[i]), 2) / (abs(q.vec[i]) + abs(b.vec[i]) + 1e-10) / 2)), 6) AS chi_square,
 round(list_sum(list_transform(range(1, 65), lambda i: least(abs(q.vec[i]), abs(b.vec[i])))), 6) AS intersection FROM v_desc q, v_desc b WHERE q.desc_id % 20 = 0""")
def f11_histogram_metrics(spark, sf):
    """The vectors whose id is divisible by 20, as a stated query set, against all."""
    d = view(spark, sf, "v_desc").select("desc_id", F.transform("vec", lambda x: F.abs(x)).alias("vec"))
    q = d.where("desc_id % 20 = 0").select(F.col("desc_id").alias("query_id"), F.col("vec").alias("qvec"))
    return E.histogram_distances(q, d).select("query_id", "desc_id", *(rounded(m, 6).alias(m) for m in ("chi_square", "intersection")))


@query("f12_in_group")
def f12_in_group(spark, sf):
    return E.in_group(f11_similar(spark, sf), 0.3)


ORACLE_SQL["f12_in_group"] = "SELECT query_id, sum(CASE WHEN rank <= 5 AND score >= 0.3 THEN 1 ELSE 0 END) >= 3 AS member FROM (" + ORACLE_SQL["f11_similar"] + ") t GROUP BY query_id"

"""Queries on texture vectors, binary patterns, tile callbacks, scored polygon layers and genetic routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from agrispark.functions import spectral as S
from agrispark.operators import detectors as D, features as T, models as M
from agrispark.plans.fixtures import view
from agrispark.plans.register import half_up, query
from agrispark.session import stored

COLUMNS = ["nir", "red"]
CUT = round(2 * 0.534065766 - 1, 9)  # the threshold is stated for the index scaled to 0..1


def _rings(spark, sf):
    """A square polygon around the middle of each tile, named like the texture objects."""
    tiles = view(spark, sf, "v_pixels").select("tile_row", "tile_col").distinct()
    x, y = F.col("tile_col") * 20 + 2, F.col("tile_row") * 20 + 2
    corner = lambda dx, dy: F.struct((x + dx).cast("double").alias("x"), (y + dy).cast("double").alias("y"))
    return tiles.select((F.col("tile_row") * 1000 + F.col("tile_col")).alias("obj"), F.array(corner(0, 0), corner(16, 0), corner(16, 16), corner(0, 16)).alias("ring"))


def _matrix(spark, sf):
    return T.feature_matrix([(_rings(spark, sf), view(spark, sf, "v_pixels").select("x", "y", "green", "ext_green", "ext_red", *COLUMNS))], COLUMNS, S.index("NGRDI") > CUT)


_FEATURES = f"""WITH win AS (SELECT tile_row * 1000 + tile_col AS obj, x, y, {S.formula_sql('NGRDI')} > {CUT} AS marked, nir, red FROM v_pixels WHERE x % 20 BETWEEN 2 AND 17 AND y % 20 BETWEEN 2 AND 17),
 whole AS (SELECT obj, min(nir) AS nl, max(nir) AS nh, min(red) AS rl, max(red) AS rh, count(*) AS n FROM win GROUP BY 1),
 box AS (SELECT obj, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM win WHERE marked GROUP BY 1),
 o AS (SELECT w.obj, 'nir' AS name, x, y, CASE WHEN marked THEN CAST(round_even((nir - nl) / CAST(nh - nl AS DOUBLE) * 255, 0) AS INTEGER) ELSE 0 END AS v FROM win w JOIN whole a ON a.obj = w.obj JOIN box b ON b.obj = w.obj WHERE n >= 9 AND nh > nl AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1
 UNION ALL SELECT w.obj, 'red', x, y, CASE WHEN marked THEN CAST(round_even((red - rl) / CAST(rh - rl AS DOUBLE) * 255, 0) AS INTEGER) ELSE 0 END FROM win w JOIN whole a ON a.obj = w.obj JOIN box b ON b.obj = w.obj WHERE n >= 9 AND rh > rl AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1),
 d AS (SELECT * FROM (VALUES (0, 1, 0), (45, 1, -1), (90, 0, 1), (135, 1, 1)) t(angle, dx, dy)),
 p AS (SELECT a.obj, a.name, angle, a.v AS i, b.v AS j FROM o a, d, o b WHERE b.obj = a.obj AND b.name = a.name AND b.x = a.x + dx AND b.y = a.y + dy),
 s AS (SELECT obj, name, angle, i, j FROM p UNION ALL SELECT obj, name, angle, j, i FROM p),
 g AS (SELECT obj, name, angle, i, j, count(*) / CAST(sum(count(*)) OVER (PARTITION BY obj, name, angle) AS DOUBLE) AS p FROM s GROUP BY obj, name, angle, i, j),
 m AS (SELECT obj, name, angle, sum(i * p) AS mu FROM g GROUP BY 1, 2, 3),
 e AS (SELECT g.obj, g.name, g.angle, sum(p * p) AS asm, sum(p * (i - j) * (i - j)) AS contrast, sum(p * (i - mu) * (j - mu)) / sum(p * (i - mu) * (i - mu)) AS correlation, sum(p * abs(i - j)) AS dissimilarity, sqrt(sum(p * p)) AS energy, sum(-p * ln(p)) AS entropy,
 sum(p / (1 + (i - j) * (i - j))) AS homogeneity, max(mu) AS mean, sqrt(sum(p * (i - mu) * (i - mu))) AS std, sum(p * (i - mu) * (i - mu)) AS variance FROM g JOIN m ON m.obj = g.obj AND m.name = g.name AND m.angle = g.angle GROUP BY 1, 2, 3)
 SELECT obj, """ + ", ".join(f"round(avg(CASE WHEN name = '{c}' THEN {p} END), 5) AS {c}_{p}" for c in COLUMNS for p in T.PROPS) + " FROM e GROUP BY obj"


@query("f5_f7_feature_matrix", _FEATURES)
def f5_f7_feature_matrix(spark, sf):
    return _matrix(spark, sf).select("obj", *(F.round(n, 5).alias(n) for n in T.feature_names(COLUMNS)))


def lbp_sql(band: str = "nir", radius: int = 3, points: int = 8) -> str:
    ring = ", ".join(f"({k}, {dx}, {dy}, {w}::BIGINT)" for k, dx, dy, w in T.circle_weights(radius, points))
    return f"""WITH o AS (SELECT tile_row * 1000 + tile_col AS obj, x, y, CAST(floor({band} / 64.0) AS INTEGER) AS v FROM v_pixels), c AS (SELECT * FROM (VALUES {ring}) t(k, dx, dy, w)),
 n AS (SELECT a.obj, a.x, a.y, c.k, coalesce(sum(c.w * b.v), 0) >= 10000000000 * any_value(a.v) AS bit FROM o a CROSS JOIN c LEFT JOIN o b ON b.obj = a.obj AND b.x = a.x + c.dx AND b.y = a.y + c.dy GROUP BY 1, 2, 3, 4),
 l AS (SELECT obj, x, y, k, CAST(bit AS INTEGER) AS bit, CAST(bit <> lag(bit) OVER (PARTITION BY obj, x, y ORDER BY k) AS INTEGER) AS change FROM n),
 t AS (SELECT obj, x, y, CASE WHEN sum(change) <= 2 THEN sum(bit) ELSE {points + 1} END AS code FROM l GROUP BY 1, 2, 3), h AS (SELECT obj, code, count(*) AS n FROM t GROUP BY 1, 2),
 q AS (SELECT obj, code, n / CAST(sum(n) OVER (PARTITION BY obj) AS DOUBLE) AS p FROM h), mu AS (SELECT obj, sum(p * code ORDER BY code) AS mu FROM q GROUP BY 1)
 SELECT q.obj, round(max(mu), 6) AS lbp_mean, round(sum(p * (code - mu) * (code - mu) ORDER BY code), 6) AS lbp_var, round(sum(p * p ORDER BY code), 6) AS lbp_energy, round(-sum(p * log2(p) ORDER BY code), 6) AS lbp_entropy FROM q JOIN mu ON mu.obj = q.obj GROUP BY q.obj"""


@query("f4_binary_patterns", lbp_sql())
def f4_binary_patterns(spark, sf):
    o = view(spark, sf, "v_pixels").select((F.col("tile_row") * 1000 + F.col("tile_col")).alias("obj"), "x", "y", F.floor(F.col("nir") / 64).cast("int").alias("v"))
    return T.pattern_stats(T.local_patterns(o)).select("obj", *(half_up(n, 6).alias(n) for n in ("lbp_mean", "lbp_var", "lbp_energy", "lbp_entropy")))


@query("o17_o18_scored_layer")
def o17_o18_scored_layer(spark, sf):
    """Square polygons scored by a detector that is fitted on all of their textures."""
    layer, found = _rings(spark, sf), stored(_matrix(spark, sf))  # several passes read it
    detector = D.Distance(T.feature_names(COLUMNS)).fit(found)
    return D.score_layer(layer, found, detector, D.cut_at(detector, found, 0.05)).select("obj", F.round("score", 5).alias("score"), "is_inlier")


@query("x1_tile_callback", "SELECT tile_row, tile_col, count(*) AS n, CAST(sum(CASE WHEN blob = 1 THEN nir ELSE 0 END) AS BIGINT) AS nir FROM v_pixels GROUP BY 1, 2")
def x1_tile_callback(spark, sf):
    def call(p):
        return p.iloc[:1][["tile_row", "tile_col"]].assign(n=len(p), nir=int((p.nir * p.blob).sum()))

    return T.map_tiles(view(spark, sf, "v_pixels").select("tile_row", "tile_col", "x", "y", "nir", "blob"), call, "tile_row int, tile_col int, n long, nir long")


@query("x2_detector", """SELECT pix_id, round(-abs(nir - (SELECT avg(nir) FROM v_pixels)), 4) AS score FROM v_pixels""")
def x2_detector(spark, sf):
    """A detector that a user brings: how far the near infrared is from its mean."""

    class FromMean:
        def fit(self, features):
            self.mean = features.agg(F.avg("nir")).first()[0]
            return self

        def score(self, features):
            return features.withColumn("score", -F.abs(F.col("nir") - self.mean))

    p = view(spark, sf, "v_pixels").select("pix_id", "nir")
    return FromMean().fit(p).score(p).select("pix_id", F.round("score", 4).alias("score"))


@query("r5_genetic_routes")
def r5_genetic_routes(spark, sf):
    return M.genetic_routes(view(spark, sf, "v_points"))

"""Texture vectors of objects: quantising, binary patterns, feature matrices of polygon layers, callbacks on tiles."""

from __future__ import annotations

from collections.abc import Callable
from math import cos, floor, pi, sin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from agrispark.functions.geometry import inside_ring, ring_bounds
from agrispark.operators.segments import TILE, glcm, glcm_props

PROPS = ["asm", "contrast", "correlation", "dissimilarity", "energy", "entropy", "homogeneity", "mean", "std", "variance"]
UNIT = 100_000  # neighbours' offsets are rounded to five decimals, so that their weights are whole numbers


def map_tiles(pixels: DataFrame, call: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``call`` on the pixels of each tile, ordered by row and column; a tile's size bounds what one call gets."""
    return pixels.groupBy(*TILE).applyInPandas(lambda p: call(p.sort_values(["y", "x"], ignore_index=True)), schema)


def polygon_windows(rings: DataFrame, pixels: DataFrame, mask: Column, key: str = "obj", least: int = 9) -> DataFrame:
    """The pixels of each polygon's window, ``key, x, y, marked`` and the pixels' other columns.

    rings: ``key, ring`` in pixel units. ``marked`` is ``mask`` on the pixel. Null rings, rings under three corners and
    polygons with fewer than ``least`` pixel centres inside are left out; so is what lies off the raster.
    """
    ax, ay, bx, by = ring_bounds(F.col("ring"))
    whole = lambda a, b: F.sequence(F.floor(a), F.greatest(F.floor(a) + F.ceil(b - a) - 1, F.floor(a)))
    at = rings.where(F.size("ring") >= 3).select(key, "ring", F.explode(whole(ay, by)).alias("y"), ax.alias("_ax"), bx.alias("_bx"))
    at = at.select(key, "ring", "y", F.explode(whole(F.col("_ax"), F.col("_bx"))).alias("x"))
    at = at.select(key, F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), inside_ring(F.col("ring"), F.col("x") + 0.5, F.col("y") + 0.5).alias("_in"))
    rest = [c for c in pixels.columns if c not in (key, "x", "y", "marked", "_in")]
    met = at.join(pixels.select("x", "y", *rest, F.coalesce(mask, F.lit(False)).alias("marked")), ["x", "y"])
    inside = F.count_if("_in").over(Window.partitionBy(key))
    return met.withColumn("_n", inside).where(F.col("_n") >= least).select(key, "x", "y", "marked", *rest)


def quantised(windows: DataFrame, columns: list[str], key: str = "obj") -> DataFrame:
    """Columns as 0..255 between their bounds in the window, long form: ``obj`` (struct of key and name), ``x, y, v``.

    Cut to the bounds of the marked pixels; the others in there are 0, and so are nulls and NaN. A flat column of an
    object, and an object without a mark, give no rows.
    """
    w = Window.partitionBy(key)
    clean = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns}
    wide = windows.select(key, "x", "y", "marked", *(c.alias(n) for n, c in clean.items()))
    lo_hi = lambda n: [F.min(n).over(w).alias(f"_lo_{n}"), F.max(n).over(w).alias(f"_hi_{n}")]
    box = [f(F.when(F.col("marked"), F.col(a))).over(w).alias(f"_{f.__name__}_{a}") for f in (F.min, F.max) for a in "xy"]
    cut = wide.select("*", *box, *(b for n in columns for b in lo_hi(n)))
    cut = cut.where("x BETWEEN _min_x AND _max_x AND y BETWEEN _min_y AND _max_y")

    def level(n: str) -> Column:
        lo, hi = F.col(f"_lo_{n}"), F.col(f"_hi_{n}")
        v = F.coalesce(F.when(F.col("marked"), F.rint((F.col(n) - lo) / (hi - lo) * 255)), F.lit(0.0))
        return F.struct(F.lit(n).alias("name"), F.when(hi > lo, v).cast("int").alias("v"))

    long = cut.select(key, "x", "y", F.explode(F.array(*(level(n) for n in columns))).alias("l")).where("l.v IS NOT NULL")
    return long.select(F.struct(F.col(key), F.col("l.name")).alias("obj"), "x", "y", F.col("l.v").alias("v"))


def feature_names(columns: list[str]) -> list[str]:
    """Names of a vector's places: columns, then properties, both in the order of their names."""
    return [f"{c}_{p}" for c in sorted(columns) for p in PROPS]


def texture_vectors(windows: DataFrame, columns: list[str], key: str = "obj") -> DataFrame:
    """One row of texture features per object: ``key`` and ``feature_names(columns)``; 0 where a column is flat or a value isn't finite."""
    props = glcm_props(glcm(quantised(windows, columns, key)))
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    one = lambda c, p: F.coalesce(F.max(F.when(F.col("obj.name") == c, finite(F.col(p)))), F.lit(0.0)).alias(f"{c}_{p}")
    return props.groupBy(F.col(f"obj.{key}").alias(key)).agg(*(one(c, p) for c in sorted(columns) for p in PROPS))


def feature_matrix(fields: list[tuple[DataFrame, DataFrame]], columns: list[str], mask: Column, share: float = 1.0, key: str = "obj", seed: int = 42) -> DataFrame:
    """``field, key`` and the texture features of a seeded share of each field's polygons: (rings, pixels) per field, stacked."""
    out = None
    for number, (rings, pixels) in enumerate(fields):
        some = rings if share >= 1 else rings.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) < int(share * 1_000_000))
        one = texture_vectors(polygon_windows(some, pixels, mask, key), columns, key).select(F.lit(number).alias("field"), "*")
        out = one if out is None else out.unionByName(one)
    return out


# --- local binary patterns -------------------------------------------------------------------------------------


def circle_weights(radius: int = 3, points: int = 8) -> list[tuple[int, int, int, int]]:
    """``point, dx, dy, weight`` of the pixels around each point of a circle; a point's weights sum to UNIT squared."""
    out = []
    for k in range(points):
        x, y = round(radius * cos(2 * pi * k / points), 5), round(-radius * sin(2 * pi * k / points), 5)
        fx, fy = round((x - floor(x)) * UNIT), round((y - floor(y)) * UNIT)
        for i, wx in ((0, UNIT - fx), (1, fx)):
            out += [(k, floor(x) + i, floor(y) + j, wx * wy) for j, wy in ((0, UNIT - fy), (1, fy)) if wx * wy]
    return out


def local_patterns(objects: DataFrame, radius: int = 3, points: int = 8) -> DataFrame:
    """Uniform binary patterns of ``obj, x, y, v`` (whole numbers): ``obj, x, y, code``.

    A bit is set where the bilinear value on the circle reaches the centre's; pixels off the object are 0. Up to two
    changes along the bits give their number, others ``points`` + 1. Each pixel sends its share to the centres around
    it, which one aggregate sums; whole-number weights keep ties exact.
    """
    sent = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(-dx).alias("dx"), F.lit(-dy).alias("dy"), F.lit(w).cast("long").alias("w")) for k, dx, dy, w in [(-1, 0, 0, 1), *circle_weights(radius, points)]))
    to = objects.select("obj", "x", "y", "v", F.explode(sent).alias("s"))
    to = to.select("obj", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"), F.col("s.k").alias("k"), (F.col("s.w") * F.col("v")).alias("w"))
    on = lambda k: F.sum(F.when(F.col("k") == k, F.col("w")))
    met = to.groupBy("obj", "x", "y").agg(on(-1).alias("c"), *(F.coalesce(on(k), F.lit(0)).alias(f"s{k}") for k in range(points))).where("c IS NOT NULL")
    bit = [(F.col(f"s{k}") >= F.col("c") * (UNIT * UNIT)).cast("int") for k in range(points)]
    total = lambda cs: sum(cs[1:], cs[0])
    changes = total([(a != b).cast("int") for a, b in zip(bit, bit[1:])])
    return met.select("obj", "x", "y", F.when(changes <= 2, total(bit)).otherwise(points + 1).alias("code"))


def pattern_stats(codes: DataFrame) -> DataFrame:
    """``obj, lbp_mean, lbp_var, lbp_energy, lbp_entropy`` (log2) of the histogram of ``obj, code``."""
    n = codes.groupBy("obj", "code").agg(F.count(F.lit(1)).alias("n"))
    # at most as many bins as codes an object, summed in the order of their codes
    bins = n.groupBy("obj").agg(F.array_sort(F.collect_list(F.struct("code", "n"))).alias("bins"), F.sum("n").cast("double").alias("t"))
    bins = bins.select("obj", F.transform("bins", lambda b: F.struct(b["code"].alias("code"), (b["n"] / F.col("t")).alias("p"))).alias("bins"))

    def total(value) -> Column:
        return F.aggregate("bins", F.lit(0.0), lambda s, b: s + value(b["code"], b["p"]))

    bins = bins.withColumn("lbp_mean", total(lambda code, p: p * code))
    from_mean = lambda code: code - F.col("lbp_mean")
    return bins.select(
        "obj",
        "lbp_mean",
        total(lambda code, p: p * from_mean(code) * from_mean(code)).alias("lbp_var"),
        total(lambda code, p: p * p).alias("lbp_energy"),
        (-total(lambda code, p: p * F.log2(p))).alias("lbp_entropy"),
    )

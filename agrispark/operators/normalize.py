"""Stretches and statistics of bands over tiles and whole mosaics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

TILE = ("tile_row", "tile_col")


def minmax_tile(pixels: DataFrame, column: str, out: str, tile: tuple[str, ...] = TILE) -> DataFrame:
    """``column`` stretched to 0..255 in each tile (flat: 0), truncated. The range is aggregated and joined, not windowed."""
    stats = pixels.groupBy(*tile).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    v = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 255)).otherwise(0)
    return pixels.join(stats, list(tile)).withColumn(out, v.cast("int")).drop("_lo", "_hi")


def band_ranges(pixels: DataFrame, bands: list[str]) -> DataFrame:
    """``band, lo, hi`` over all pixels."""
    one = pixels.agg(*(f(b).alias(f"{b}_{n}") for b in bands for n, f in (("lo", F.min), ("hi", F.max))))
    rows = [F.struct(F.lit(b).alias("band"), F.col(f"{b}_lo").alias("lo"), F.col(f"{b}_hi").alias("hi")) for b in bands]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def global_stretch(pixels: DataFrame, bands: list[str]) -> DataFrame:
    """Bands stretched to 0..255 with the one range of them all."""
    r = pixels.agg(F.least(*(F.min(b) for b in bands)).alias("_lo"), F.greatest(*(F.max(b) for b in bands)).alias("_hi"))
    scaled = [F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col(b) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 255)).otherwise(0).cast("int").alias(f"{b}_u8") for b in bands]
    return pixels.crossJoin(F.broadcast(r)).select("*", *scaled).drop("_lo", "_hi")  # one row


def pct_stretch(pixels: DataFrame, column: str, out: str, lo: float = 0.02, hi: float = 0.98) -> DataFrame:
    """``column`` clipped to its exact percentiles and stretched to 0..255."""
    r = pixels.agg(F.percentile(column, F.array(F.lit(lo), F.lit(hi))).alias("_p"))
    a, b = F.element_at("_p", 1), F.element_at("_p", 2)
    v = F.floor((F.least(F.greatest(F.col(column).cast("double"), a), b) - a) / (b - a) * 255)
    return pixels.crossJoin(F.broadcast(r)).withColumn(out, F.when(b > a, v).otherwise(0).cast("int")).drop("_p")  # one row


#: Ranges of bands of which no tile has a value (fixed values).
FALLBACK = {"red": (0, 65535), "green": (0, 65535), "blue": (0, 65535), "ext_green": (0, 400), "ext_red": (0, 400), "rededge": (0, 400), "nir": (0, 65535)}


def global_band_stats(
    pixels: DataFrame, bands: list[str], fill: int = 0, tile: tuple[str, ...] = TILE, nodata: float | None = None, fallback: dict[str, tuple[float, float]] | None = None
) -> DataFrame:
    """``band, lo, hi``: means of the tiles' least and greatest values; values up to ``fill`` and ``nodata`` are left out.

    Tiles without a value of a band don't count for it; a band without any
    takes its range in ``fallback``, or nulls.
    """

    def ok(b: str) -> Column:
        real = F.col(b) > fill
        return F.when(real if nodata is None else real & (F.col(b) != nodata), F.col(b))

    tiles = pixels.groupBy(*tile).agg(*(f(ok(b)).alias(f"{b}_{n}") for b in bands for n, f in (("lo", F.min), ("hi", F.max))))
    one = tiles.agg(*(F.avg(f"{b}_{n}").alias(f"{b}_{n}") for b in bands for n in ("lo", "hi")))
    other = lambda b, i: F.lit(fallback[b][i] if fallback and b in fallback else None).cast("double")
    rows = [F.struct(F.lit(b).alias("band"), *(F.coalesce(F.col(f"{b}_{n}"), other(b, i)).alias(n) for i, n in enumerate(("lo", "hi")))) for b in bands]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def norm_range(value: Column, lo: Column, hi: Column) -> Column:
    return F.least(F.greatest((value - lo) / (hi - lo + 1e-6), F.lit(0.0)), F.lit(1.0))


def blend_stretch(pixels: DataFrame, column: str, out: str, blend: float = 0.1, tile: tuple[str, ...] = TILE) -> DataFrame:
    """Range normalisation with ``blend`` of the tile's range and the rest of the mosaic's mean range."""
    stats = global_band_stats(pixels, [column], tile=tile).select(F.col("lo").alias("_glo"), F.col("hi").alias("_ghi"))
    local = pixels.groupBy(*tile).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    lo = blend * F.col("_lo") + (1 - blend) * F.col("_glo")
    hi = blend * F.col("_hi") + (1 - blend) * F.col("_ghi")
    joined = pixels.join(local, list(tile)).crossJoin(F.broadcast(stats))  # one row
    return joined.withColumn(out, norm_range(F.col(column), lo, hi)).drop("_lo", "_hi", "_glo", "_ghi")


def linear_stretch(value: Column, lo: float, hi: float, top: float) -> Column:
    """lo..hi to 0..top, rounded half to even; lo = hi gives the middle."""
    if hi == lo:
        return F.lit(top / 2).cast("int")
    return F.bround(F.least(F.greatest((value - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0)) * top).cast("int")


def otsu(pixels: DataFrame, column: str, tile: tuple[str, ...] = TILE) -> DataFrame:
    """Each tile's Otsu threshold of an 8-bit column: the least value with the greatest variance between classes."""
    hist = pixels.groupBy(*tile, F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy(*tile).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*tile)
    run = hist.select(
        *tile, "v", F.sum("n").over(up).alias("w0"), F.sum(F.col("n") * F.col("v")).over(up).alias("s0"),
        F.sum("n").over(whole).alias("w"), F.sum(F.col("n") * F.col("v")).over(whole).alias("s"),
    )
    w0, w1 = F.col("w0").cast("double"), (F.col("w") - F.col("w0")).cast("double")
    d = F.col("s0") / w0 - (F.col("s") - F.col("s0")) / F.when(w1 > 0, w1)
    between = F.coalesce(w0 * w1 * d * d, F.lit(0.0))
    return run.groupBy(*tile).agg(F.min_by("v", F.struct(-F.round(between, 3), F.col("v"))).alias("threshold"))


def morphology(pixels: DataFrame, column: str, out: str, kind: str, r: int = 1, tile: tuple[str, ...] = TILE) -> DataFrame:
    """Erosion (min) or dilation (max) with a square of side 2r + 1: rows first, then columns."""
    f = {"erode": F.min, "dilate": F.max}[kind]
    across = Window.partitionBy(*tile, "y").orderBy("x").rangeBetween(-r, r)
    down = Window.partitionBy(*tile, "x").orderBy("y").rangeBetween(-r, r)
    return pixels.withColumn("_m", f(column).over(across)).withColumn(out, f("_m").over(down)).drop("_m")

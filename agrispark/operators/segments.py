"""Tiles, mosaics, masks and connected components on the pixel table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from agrispark.functions.geometry import inside_ring, ring_bounds
from agrispark.operators.components import closed_components

TILE = ["tile_row", "tile_col"]


def tile_grid(spark: SparkSession, width: int, height: int, size: int, overlap: int = 0) -> DataFrame:
    """Tiles of a raster: ``tile_row, tile_col, x0, y0, w, h``; tiles at the edge are cut, those beyond it left out."""
    step = size - overlap
    cols, rows = -(-(width - overlap) // step), -(-(height - overlap) // step)
    grid = spark.range(rows).select(F.col("id").cast("int").alias("tile_row"), F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("tile_col"))
    x0, y0 = F.col("tile_col") * step, F.col("tile_row") * step
    return grid.select(
        "tile_row", "tile_col", x0.alias("x0"), y0.alias("y0"), F.least(F.lit(size), F.lit(width) - x0).alias("w"), F.least(F.lit(size), F.lit(height) - y0).alias("h")
    ).where("w > 0 and h > 0")


def assign_tiles(pixels: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """A row for each pixel and tile that holds it, by arithmetic; replaces tile_row and tile_col."""
    step = size - overlap

    def tiles(c: str) -> Column:
        first = F.greatest(F.ceil((F.col(c) - size + 1) / F.lit(step)), F.lit(0)).cast("int")
        return F.sequence(first, F.floor(F.col(c) / F.lit(step)).cast("int"))

    rest = pixels.drop("tile_row", "tile_col")
    return rest.withColumn("tile_row", F.explode(tiles("y"))).withColumn("tile_col", F.explode(tiles("x")))


def mosaic(tile_pixels: DataFrame, bands: list[str], order: str = "last") -> DataFrame:
    """One row a pixel: of overlapping tiles the last (or first) by row and column wins."""
    pick = F.max_by if order == "last" else F.min_by
    key = F.struct("tile_row", "tile_col")
    return tile_pixels.groupBy("x", "y").agg(pick(F.struct(*bands), key).alias("b")).select("x", "y", "b.*")


def covered_tiles(pixels: DataFrame, least: float = 0.2, alpha: str | None = "alpha", nodata: float | None = None, band: str = "red", white: int = 65535) -> DataFrame:
    """Tiles of which at least a share is real: ``tile_row, tile_col, share``.

    A pixel is real if its alpha is over 0; of rasters without alpha
    (``alpha=None``) if ``band`` isn't the nodata value, or, where there is
    none, isn't white. Nulls aren't real.
    """
    real = F.col(alpha) > 0 if alpha else F.col(band) != (white if nodata is None else nodata)
    share = F.avg(F.coalesce(real.cast("double"), F.lit(0.0)))
    return pixels.groupBy(*TILE).agg(share.alias("share")).where(F.col("share") >= least)


def segments(mask: DataFrame) -> DataFrame:
    """8-neighbour components of the rows of ``mask`` (x, y, pix_id by tile) with their boxes.

    Runs of pixels in a row are found first; runs that touch are edges, so the
    graph has a node for each run and not for each pixel.
    ``tile_row, tile_col, seg_id, x, y, w, h, n_px``.
    """
    row = Window.partitionBy(*TILE, "y").orderBy("x")
    runs = (
        mask.select(*TILE, "x", "y", "pix_id", (F.col("x") - F.row_number().over(row)).alias("g"))
        .groupBy(*TILE, "y", "g")
        .agg(F.min("pix_id").alias("run"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    )
    a = runs.select(*TILE, F.col("y").alias("y"), F.col("run").alias("u"), F.col("x0").alias("a0"), F.col("x1").alias("a1"))
    b = runs.select(*TILE, (F.col("y") - 1).alias("y"), F.col("run").alias("v"), F.col("x0").alias("b0"), F.col("x1").alias("b1"))
    touch = a.join(b, [*TILE, "y"]).where("b0 <= a1 + 1 and a0 <= b1 + 1").select(*TILE, "u", "v")
    comp = closed_components(touch, TILE)
    return (
        runs.join(comp, runs.run == comp.id, "left")
        .groupBy(*TILE, F.coalesce("component", "run").alias("seg_id"))
        .agg(F.min("x0").alias("x"), F.min("y").alias("y"), F.max("x1").alias("x1"), F.max("y").alias("y1"), F.sum(F.col("x1") - F.col("x0") + 1).alias("n_px"))
        .select(*TILE, "seg_id", "x", "y", (F.col("x1") - F.col("x") + 1).alias("w"), (F.col("y1") - F.col("y") + 1).alias("h"), "n_px")
    )


def filter_area(segs: DataFrame, least: int, most: int) -> DataFrame:
    """Segments whose box area is within bounds."""
    return segs.where((F.col("w") * F.col("h")).between(least, most))


def segment_labels(segs: DataFrame, size: int) -> DataFrame:
    """Centre boxes in 0..1 of the tile."""
    return segs.select(
        *TILE, "seg_id",
        ((F.col("x") % size + F.col("w") / 2) / size).alias("cx"), ((F.col("y") % size + F.col("h") / 2) / size).alias("cy"),
        (F.col("w") / size).alias("bw"), (F.col("h") / size).alias("bh"),
    )


def glcm(objects: DataFrame) -> DataFrame:
    """Symmetric co-occurrence shares at distance 1 and four angles of ``obj, x, y, v``: ``obj, angle, i, j, p``."""
    steps = {0: (1, 0), 45: (1, -1), 90: (0, 1), 135: (1, 1)}
    places = F.array(*(F.struct(F.lit(angle).alias("angle"), (F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y")) for angle, (dx, dy) in steps.items()))
    near = objects.select("obj", F.col("v").alias("j"), F.explode(places).alias("at")).select("obj", "j", "at.*")
    pairs = objects.join(near, ["obj", "x", "y"]).select("obj", "angle", F.col("v").alias("i"), "j")
    ways = F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("p")
    both = pairs.select("obj", "angle", ways).select("obj", "angle", "p.i", "p.j")
    counts = both.groupBy("obj", "angle", "i", "j").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("obj", "angle").agg(F.sum("n").alias("total"))
    return counts.join(total, ["obj", "angle"]).select("obj", "angle", "i", "j", (F.col("n") / F.col("total")).alias("p"))


def glcm_props(pairs: DataFrame) -> DataFrame:
    """Texture features of each object, means over the angles."""
    i, j, p = (F.col(c) for c in "ijp")
    mean = pairs.groupBy("obj", "angle").agg(F.sum(i * p).alias("mu"))
    each = pairs.join(mean, ["obj", "angle"]).groupBy("obj", "angle").agg(
        F.sum(p * (i - j) * (i - j)).alias("contrast"), F.sum(p * F.abs(i - j)).alias("dissimilarity"), F.sum(p / (1 + (i - j) * (i - j))).alias("homogeneity"),
        F.sum(p * p).alias("asm"), F.first("mu").alias("mean"), F.sum(p * (i - F.col("mu")) * (i - F.col("mu"))).alias("variance"),
        F.sum(p * (i - F.col("mu")) * (j - F.col("mu"))).alias("cov"), F.sum(-p * F.log(p)).alias("entropy"),
    )
    each = each.withColumns(
        {"energy": F.sqrt("asm"), "std": F.sqrt("variance"), "correlation": F.when(F.col("variance") > 1e-15, F.col("cov") / F.col("variance")).otherwise(F.lit(1.0))}
    )
    names = ["asm", "contrast", "correlation", "dissimilarity", "energy", "entropy", "homogeneity", "mean", "std", "variance"]
    return each.groupBy("obj").agg(*(F.avg(n).alias(n) for n in names))


def segment_pixels(mask: DataFrame) -> DataFrame:
    """The rows of ``mask`` with the ``seg_id`` of their 8-neighbour component in the tile."""
    row = Window.partitionBy(*TILE, "y").orderBy("x")
    marked = mask.withColumn("_g", F.col("x") - F.row_number().over(row))
    first = Window.partitionBy(*TILE, "y", "_g")
    marked = marked.withColumn("_run", F.min("pix_id").over(first))
    runs = marked.groupBy(*TILE, "y", "_run").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    b = runs.select(*TILE, (F.col("y") - 1).alias("y"), F.col("_run").alias("v"), F.col("x0").alias("b0"), F.col("x1").alias("b1"))
    touch = runs.join(b, [*TILE, "y"]).where("b0 <= x1 + 1 and x0 <= b1 + 1").select(*TILE, F.col("_run").alias("u"), "v")
    comp = closed_components(touch, TILE).select(F.col("id").alias("_run"), "component")
    return marked.join(comp, "_run", "left").withColumn("seg_id", F.coalesce("component", "_run")).drop("_g", "_run", "component")


def pixels_in_rings(rings: DataFrame, key: str = "ring_id") -> DataFrame:
    """Pixels whose centre is inside a polygon: ``key, x, y`` of ``key, ring`` (array of x, y in pixel units).

    Candidates are the pixels of the polygon's bounds, by arithmetic, so no
    join is needed. Rings under three corners and null rings hold none.
    """
    lo_x, lo_y, hi_x, hi_y = ring_bounds(F.col("ring"))
    boxes = rings.where(F.size("ring") >= 3).select(key, "ring", lo_x.alias("_ax"), lo_y.alias("_ay"), hi_x.alias("_bx"), hi_y.alias("_by"))
    span = lambda a, b: F.sequence(F.floor(a).cast("int"), F.floor(b).cast("int"))
    cand = boxes.withColumn("y", F.explode(span("_ay", "_by"))).withColumn("x", F.explode(span("_ax", "_bx")))
    return cand.where(inside_ring(F.col("ring"), F.col("x") + F.lit(0.5), F.col("y") + F.lit(0.5))).select(key, "x", "y")


def box_pixels(boxes: DataFrame, key: str) -> DataFrame:
    """Whole pixels of boxes ``key, x, y, w, h`` (first pixel and size): ``key, x, y``."""
    b = boxes.where("w > 0 and h > 0").select(key, F.col("x").alias("_x"), F.col("y").alias("_y"), "w", "h")
    rows = b.withColumn("y", F.explode(F.sequence(F.col("_y"), F.col("_y") + F.col("h") - 1)))
    return rows.withColumn("x", F.explode(F.sequence(F.col("_x"), F.col("_x") + F.col("w") - 1))).select(key, "x", "y")


def tighten_boxes(boxes: DataFrame, mask: DataFrame, key: str, least: int = 4) -> DataFrame:
    """Boxes drawn to the bounds of the largest mask segment in them: ``key, x, y, w, h, n_px``.

    Largest by pixels, ties by the upper left corner. A box keeps its own
    bounds, n_px null, if it has no segment or one whose bounds are under ``least`` pixels.
    """
    inside = box_pixels(boxes, key).join(mask.select("x", "y").distinct(), ["x", "y"])
    name = F.concat_ws(":", F.col(key).cast("string"), F.lpad(F.col("y").cast("string"), 10, "0"), F.lpad(F.col("x").cast("string"), 10, "0"))
    segs = segments(inside.select(F.col(key).alias("tile_row"), F.lit(0).alias("tile_col"), "x", "y", name.alias("pix_id")))
    best = segs.groupBy(F.col("tile_row").alias(key)).agg(F.max_by(F.struct("x", "y", "w", "h", "n_px"), F.struct("n_px", -F.col("y"), -F.col("x"))).alias("s"))
    good = F.col("s.w") * F.col("s.h") >= least
    own = boxes.select(key, "x", "y", "w", "h").join(best, key, "left")
    return own.select(key, *(F.when(good, F.col(f"s.{c}")).otherwise(F.col(c)).alias(c) for c in "xywh"), F.when(good, F.col("s.n_px")).alias("n_px"))


def resample(targets: DataFrame, source: DataFrame, bands: list[str], keys: list[str]) -> DataFrame:
    """Bilinear values of ``source`` (x, y, bands) at the places ``sx, sy`` (pixel units, centres at .5) of ``targets``.

    Each place goes to its four neighbours, which meet the source in one
    equi-join; neighbours outside the source lose their weight, and a place
    without one gives null.
    """
    fx, fy = F.col("sx") - 0.5, F.col("sy") - 0.5
    x0, y0 = F.floor(fx), F.floor(fy)
    four = [
        F.struct((x0 + i).cast("int").alias("x"), (y0 + j).cast("int").alias("y"), ((fx - x0 if i else 1 - fx + x0) * (fy - y0 if j else 1 - fy + y0)).alias("w"))
        for i in (0, 1) for j in (0, 1)
    ]
    near = targets.select(*keys, F.explode(F.array(*four)).alias("n")).select(*keys, "n.*")
    met = near.join(source.select("x", "y", *bands), ["x", "y"], "left").groupBy(*keys)
    total = lambda b: F.sum(F.when(F.col(b).isNotNull(), F.col("w")))
    return met.agg(*((F.sum(F.col("w") * F.col(b)) / F.when(total(b) > 0, total(b))).alias(b) for b in bands))

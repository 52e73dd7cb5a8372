"""Three-band pictures of bands and indices, tile by tile or by the mosaic's mean ranges."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

from agrispark.functions import spectral as S
from agrispark.operators.normalize import TILE, global_band_stats, norm_range

#: Channels of the named composites; 0 is an empty channel (fixed values).
COMPOSITES = {
    "RED_GREEN_NIR": ("ext_red", "ext_green", "nir"),
    "RED_NIR_NDVI": ("ext_red", "nir", "NDVI"),
    "RED_REDEDGE_NIR": ("ext_red", "rededge", "nir"),
    "RED_GREEN_NDVI": ("ext_red", "ext_green", "NDVI"),
    "NIR_RED_NO_BLUE": ("nir", "ext_red", 0),
    "NIR_RED_NGRDI": ("nir", "ext_red", "NGRDI"),
    "NIR_GREEN_NO_BLUE": ("nir", "ext_green", 0),
    "NGRDI_NDVI_RVI": ("RVI", "NDVI", "NGRDI"),
    "EXGR_GREEN_NIR": ("EXGR", "ext_green", "nir"),
    "NRN": ("nir", "red", "NGRDI"),
    "RGB": ("red", "green", "blue"),
}


def _value(part: str | int) -> Column:
    return F.lit(0.0) if part == 0 else S.index(part) if part in S.FORMULAS else F.col(part).cast("double")


def band_stack(pixels: DataFrame, parts: list[str | int], names: list[str] | None = None, joint: bool = False, tile: tuple[str, ...] = TILE) -> DataFrame:
    """Bands and indices stretched to 0..255 of each tile, truncated; one aggregate and one join for them all.

    names: of the new columns (default: lower-case parts). joint: one range for
    all of them. Flat channels, or all nulls, are 0; a null is 0.
    """
    names = names or [str(p).lower() for p in parts]
    raw = pixels.select("*", *(_value(p).alias(f"_v{i}") for i, p in enumerate(parts)))
    stats = raw.groupBy(*tile).agg(*(f(f"_v{i}").alias(f"_{n}{i}") for i in range(len(parts)) for n, f in (("lo", F.min), ("hi", F.max))))
    if joint and len(parts) > 1:
        lo, hi = (f(*(F.col(f"_{n}{i}") for i in range(len(parts)))) for n, f in (("lo", F.least), ("hi", F.greatest)))
        stats = stats.select(*tile, *(c.alias(f"_{n}{i}") for i in range(len(parts)) for n, c in (("lo", lo), ("hi", hi))))
    out = []
    for i, name in enumerate(names):
        lo, hi, v = (F.col(f"_{n}{i}") for n in ("lo", "hi", "v"))
        out.append(F.coalesce(F.when(hi > lo, F.floor((v - lo) / (hi - lo) * 255)), F.lit(0)).cast("int").alias(name))
    kept = [c for c in pixels.columns if c not in names]
    return raw.join(stats, list(tile)).select(*kept, *out)


def exported(pixels: DataFrame, bands: list[str]) -> DataFrame:
    """Chosen bands stretched to 0..255 of each tile, as ``c1, c2, ...`` in the reverse of their order (so that red, green, blue gives blue first)."""
    return band_stack(pixels, bands[::-1], [f"c{i + 1}" for i in range(len(bands))])


def composite(pixels: DataFrame, name: str) -> DataFrame:
    """A named composite as ``c1, c2, c3``, each channel by its tile's range; an unknown name is an error."""
    if name == "NEN":
        return band_stack(pixels, ["NGRDI", "ext_red", "nir"], ["c1", "c2", "c3"], joint=True)
    if name not in COMPOSITES:
        raise ValueError(f"unknown composite: {name}")
    return band_stack(pixels, list(COMPOSITES[name]), ["c1", "c2", "c3"])


def global_composite(pixels: DataFrame, name: str, blend: float = 0.1, fill: int = 0, tile: tuple[str, ...] = TILE) -> DataFrame:
    """A named composite whose bands are stretched by ``blend`` of the tile's range and the rest of the mosaic's; indices by their fixed range."""
    bands = sorted({p for p in COMPOSITES[name] if isinstance(p, str) and p not in S.FORMULAS})
    means = global_band_stats(pixels, bands, fill, tile).groupBy().agg(
        *(F.max(F.when(F.col("band") == b, F.col(n))).alias(f"_g{n}_{b}") for b in bands for n in ("lo", "hi"))
    )
    local = pixels.groupBy(*tile).agg(*(f(b).alias(f"_{n}_{b}") for b in bands for n, f in (("lo", F.min), ("hi", F.max))))
    out = []
    for i, part in enumerate(COMPOSITES[name], 1):
        if part in bands:
            lo, hi = (F.col(f"_{n}_{part}") * blend + F.col(f"_g{n}_{part}") * (1 - blend) for n in ("lo", "hi"))
            v = F.floor(norm_range(F.col(part), lo, hi) * 255).cast("int")
        else:
            v = F.lit(0) if part == 0 else S.scale_u8(S.index(part), part)
        out.append(v.alias(f"c{i}"))
    return pixels.join(local, list(tile)).crossJoin(F.broadcast(means)).select(*pixels.columns, *out)  # one row


def band_orders(pixels: DataFrame, bands: tuple[str, str, str], key: str = "pix_id") -> DataFrame:
    """Every order of three bands: ``key, channels, c1, c2, c3``; one pass, six rows a pixel."""
    rows = [F.struct(F.lit("-".join(p)).alias("channels"), *(F.col(b).alias(f"c{i}") for i, b in enumerate(p, 1))) for p in permutations(bands)]
    return pixels.select(key, F.explode(F.array(*rows)).alias("r")).select(key, "r.*")


def sampled_range(pixels: DataFrame, bands: list[str], height: int, every: int = 100, lo: float = 0.0, hi: float = 1.0, full: int = 65535) -> DataFrame:
    """``lo, hi``: percentiles of a fixed grid of pixels (about ten rows, each ``every``-th column), saturated values left out.

    A sampling operator: the grid is its feature. All values are saturated: those are taken.
    """
    step = max(height // 10, 1)
    values = pixels.where((F.col("y") % step == 0) & (F.col("x") % every == 0)).select(F.explode(F.array(*bands)).alias("v"))
    ends = F.array(F.lit(lo), F.lit(hi))
    both = values.agg(F.percentile(F.when(F.col("v") < full, F.col("v")), ends).alias("ok"), F.percentile("v", ends).alias("all"))
    p = F.coalesce("ok", "all")
    return both.select(F.element_at(p, 1).alias("lo"), F.element_at(p, 2).alias("hi"))


def rescale_auto(pixels: DataFrame, column: str, out: str, floor: float = 25000.0) -> DataFrame:
    """An index brought to a full range by what its values are.

    Any below 0: least..greatest to 0..top; all up to 1: times top; all up to
    255: as a share of 255 times top; else unchanged. top: the greatest value, at least ``floor``.
    """
    r = pixels.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    v, lo, hi = F.col(column), F.col("_lo"), F.col("_hi")
    top = F.greatest(hi, F.lit(floor))
    scaled = F.when(lo < 0, F.when(hi > lo, (v - lo) / (hi - lo) * top).otherwise(F.lit(0.0))).when(hi <= 1, v * top).when(hi <= 255, v / 255 * top).otherwise(v)
    return pixels.crossJoin(F.broadcast(r)).withColumn(out, scaled).drop("_lo", "_hi")  # one row

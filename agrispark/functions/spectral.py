"""Vegetation indices and scaling as column expressions.

Bands are shares of full scale. ``R`` and ``G`` are the extended red and green
bands unless other columns are named; every index is one expression, so any
choice of them is a single projection inside whole-stage code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Index formulas (fixed values); E is 1e-5.
FORMULAS = {
    "CIG": "N / (G + E) - 1",
    "CIRE": "N / (RE + E) - 1",
    "CIVE": "0.441 * B - 0.881 * G + 0.385 * R + 18.78745",
    "CVI": "N * R / (G * G + E)",
    "DVI": "N - R",
    "EVI": "2.5 * (N - R) / (N + 6 * R - 7.5 * B + 1 + E)",
    "EXG": "2 * G - R - B",
    "EXGR": "2 * G - 2.4 * R",
    "EXR": "1.4 * R - B",
    "GNDVI": "(N - G) / (N + G + E)",
    "MGRVI": "(G * G - R * R) / (G * G + R * R + E)",
    "MSAVI2": "0.5 * (2 * N + 1 - sqrt((2 * N + 1) * (2 * N + 1) - 8 * (N - R)))",
    "MSVI": "((N - R) - 1) / (sqrt(N / (R + E) + 1) + E)",
    "NDRE": "(N - RE) / (N + RE + E)",
    "NDVI": "(N - R) / (N + R + E)",
    "NGBDI": "(G - B) / (G + B + E)",
    "NGRDI": "(G - R) / (G + R + E)",
    "NGRVI": "(G * G + R * R) / (G * G - R * R + E)",
    "NPCI": "(R - B) / (R + B + E)",
    "OSAVI": "(N - R) / (N + R + 0.16)",
    "RTVICore": "100 * (N - RE) - 10 * (N - G)",
    "RVI": "N / (R + E)",
    "SAVI": "(N - R) / (N + R + 0.5) * 1.5",
    "SAVI2": "(N - R) / (N + R + 0.5) * 1.5",
    "SIPI": "(N - B) / (N - R + E)",
    "SR": "N / (R + E)",
    "SVI": "(N - G) / (N + G + E)",
    "TCARI": "3 * ((RE - R) - 0.2 * (RE - G) * (RE / (R + E)))",
    "TVI": "sqrt(abs((N - R) / (N + R + E) + 0.5))",
    "VARI": "(G - R) / (G + R - B + E)",
    "VDVI": "(2 * G - (R + B)) / (2 * G + (R + B) + E)",
    "VEG": "G / (power(R, 0.667) * power(B, 0.333) + E)",
}
#: Ranges that indices are clipped to before scaling (fixed values); others: -1 to 1.
RANGES = {
    "RVI": (0.0, 30.0), "TVI": (0.0, 1.0), "CVI": (0.0, 30.0), "CIG": (0.0, 15.0), "CIRE": (0.0, 15.0), "NGRVI": (0.0, 100.0),
    "CIVE": (18.0, 21.0), "EVI": (-1.0, 2.5), "EXG": (-2.0, 2.0), "EXGR": (-2.0, 2.0), "EXR": (-1.0, 2.0), "MSVI": (-10.0, 10.0),
    "RTVICore": (-100.0, 100.0), "SIPI": (0.0, 2.0), "SR": (0.0, 30.0), "TCARI": (-1.0, 3.0), "VEG": (0.0, 10.0),
}
#: Thresholds of index masks, as shares of the scaled range (fixed values).
MASK_THRESHOLDS = {"NGRVI": 0.016, "NDVI": 0.82, "EXGR": 0.5009, "NGRDI": 0.45, "OSAVI": 0.6295, "MGRVI": 0.5, "RVI": 0.5}
FULL = 65535


def formula_sql(name: str, red: str = "ext_red", green: str = "ext_green", full: float = 65535.0) -> str:
    """The index as SQL over band columns; an unknown name is an error."""
    if name not in FORMULAS:
        raise ValueError(f"unknown index: {name}")
    columns = {"N": "nir", "G": green, "R": red, "B": "blue", "RE": "rededge"}
    out = []
    for token in FORMULAS[name].replace("(", "( ").replace(")", " )").replace(",", " ,").split():
        out.append(f"({columns[token]} / CAST({full} AS DOUBLE))" if token in columns else "CAST(0.00001 AS DOUBLE)" if token == "E" else token)
        if token.replace(".", "").isdigit() and "." in token:
            out[-1] = f"CAST({token} AS DOUBLE)"
    return " ".join(out)


def index(name: str, red: str = "ext_red", green: str = "ext_green", full: float = 65535.0) -> Column:
    return F.expr(formula_sql(name, red, green, full))


def indices(pixels: DataFrame, names: list[str], **bands) -> DataFrame:
    """``pixels`` and a column for each named index, in one projection."""
    return pixels.select("*", *(index(n, **bands).alias(n.lower()) for n in names))


def configured(setting: str) -> list[str]:
    """Index names of a comma-separated setting, whatever their case; an unknown one is an error."""
    known = {n.upper(): n for n in FORMULAS}
    asked = [x.strip().upper() for x in setting.split(",") if x.strip()]
    unknown = [x for x in asked if x not in known]
    if unknown:
        raise ValueError(f"unknown indices: {unknown}")
    return [known[x] for x in asked]


def masked(value: Column, alpha: Column) -> Column:
    """Null where alpha is 0."""
    return F.when(alpha != 0, value)


def guarded_ratio(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), 0 where the sum is 0."""
    return F.when(a + b != 0, (a - b) / (a + b)).otherwise(F.lit(0.0))


def scale_u16(value: Column, name: str, eps: float = 0.0) -> Column:
    """Clipped to the index's range, scaled to 0..65535 and truncated."""
    lo, hi = RANGES.get(name, (-1.0, 1.0))
    return F.floor((F.least(F.greatest(value, F.lit(lo)), F.lit(hi)) - lo) / (hi - lo + eps) * FULL).cast("int")


def unscale_u16(value: Column, name: str) -> Column:
    lo, hi = RANGES.get(name, (-1.0, 1.0))
    return value / float(FULL) * (hi - lo) + lo


def scale_u8(value: Column, name: str) -> Column:
    """Scaled to 0..255; nulls and NaN give 0."""
    lo, hi = RANGES.get(name, (-1.0, 1.0))
    clean = F.when(~F.isnan(value), value)
    return F.coalesce(F.floor((F.least(F.greatest(clean, F.lit(lo)), F.lit(hi)) - lo) / (hi - lo + 1e-6) * 255).cast("int"), F.lit(0))


def fixed_u8(value: Column, lo: float, hi: float) -> Column:
    """A value clipped to a fixed range and scaled to 0..255, truncated."""
    return F.floor((F.least(F.greatest(value, F.lit(lo)), F.lit(hi)) - lo) / (hi - lo) * 255).cast("int")


#: Numbers of bands and indices in existing stacks, by place in these lists (fixed values).
STACK_BANDS = ["RED", "GREEN", "BLUE", "EXTEND_GREEN", "EXTEND_RED", "REDEDGE", "NIR"]
STACK_INDICES = [
    "NDVI", "SVI", "NGRDI", "GNDVI", "RVI", "TVI", "NDRE", "CVI", "CIG", "CIRE", "DVI", "SAVI", "OSAVI", "MSAVI2", "MGRVI", "NGRVI",
    "CIVE", "EVI", "EXG", "EXGR", "EXR", "MSVI", "NGBDI", "NPCI", "RTVICore", "SAVI2", "SIPI", "SR", "TCARI", "VARI", "VDVI", "VEG",
]


def band_refs(names: list[str | int], bands: list[str] | None = None) -> list[int]:
    """One-based positions in a stack: bands by their place in ``bands``, indices from 8 up by their fixed number, numbers as they are."""
    order = {n: i for i, n in enumerate(bands or STACK_BANDS, 1)} | {n: 7 + i for i, n in enumerate(STACK_INDICES, 1)}
    unknown = [n for n in names if not isinstance(n, int) and n not in order]
    if unknown:
        raise ValueError(f"unknown bands: {unknown}")
    return [n if isinstance(n, int) else order[n] for n in names]

"""Affine maps, rotated frames, flips, quads and UTM as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Affine:
    """x' = a x + b y + c, y' = d x + e y + f."""

    a: float
    b: float
    c: float
    d: float
    e: float
    f: float

    def __matmul__(self, o: Affine) -> Affine:
        return Affine(
            self.a * o.a + self.b * o.d, self.a * o.b + self.b * o.e, self.a * o.c + self.b * o.f + self.c,
            self.d * o.a + self.e * o.d, self.d * o.b + self.e * o.e, self.d * o.c + self.e * o.f + self.f,
        )

    def inverse(self) -> Affine:
        det = self.a * self.e - self.b * self.d
        if det == 0:
            raise ValueError("a degenerate map has no inverse")
        a, b, d, e = self.e / det, -self.b / det, -self.d / det, self.a / det
        return Affine(a, b, -a * self.c - b * self.f, d, e, -d * self.c - e * self.f)

    def apply(self, x: Column, y: Column) -> tuple[Column, Column]:
        return x * self.a + y * self.b + self.c, x * self.d + y * self.e + self.f


def tile_map(mosaic: Affine, x0: float, y0: float) -> Affine:
    """The map of a window that starts at pixel x0, y0."""
    return mosaic @ Affine(1, 0, x0, 0, 1, y0)


def rotated(tile: Affine, width: float, height: float, degrees: float) -> Affine:
    """A tile's map turned about the tile's centre."""
    t = math.radians(degrees)
    cx, cy, c, s = width / 2, height / 2, math.cos(t), math.sin(t)
    return tile @ Affine(1, 0, cx, 0, 1, cy) @ Affine(c, -s, 0, s, c, 0) @ Affine(1, 0, -cx, 0, 1, -cy)


def flipped(x: Column, y: Column, kind: str, width: Column | float, height: Column | float) -> tuple[Column, Column]:
    """Mirrored places: h, v or hv. Pixels: width - 1 and height - 1; shares: 1 and 1."""
    return (F.lit(width) - x if "h" in kind else x), (F.lit(height) - y if "v" in kind else y)


def rot90(x: Column, y: Column, width: Column | float) -> tuple[Column, Column]:
    """A quarter turn counter-clockwise of a picture of that width (pixels: width - 1; shares: 1)."""
    return y, F.lit(width) - x


def obb_corners(cx: Column, cy: Column, w: Column, h: Column, degrees: Column) -> Column:
    """Corners of a turned box as an array of ``x, y``, from the first corner around."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return F.array(*(F.struct((cx + w * i / 2 * c - h * j / 2 * s).alias("x"), (cy + w * i / 2 * s + h * j / 2 * c).alias("y")) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1))))


def ring_bounds(ring: Column) -> tuple[Column, Column, Column, Column]:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def inside_ring(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point is inside a ring, by crossings to its right; null for a null ring."""
    n = F.size(ring)

    def crosses(p: Column, i: Column) -> Column:
        q = F.get(ring, (i + 1) % n)
        at = p["x"] + (y - p["y"]) * (q["x"] - p["x"]) / F.when(q["y"] != p["y"], q["y"] - p["y"])
        return ((p["y"] > y) != (q["y"] > y)) & (x < at)

    return F.size(F.filter(ring, lambda p, i: F.coalesce(crosses(p, i), F.lit(False)))) % 2 == 1


# WGS84 and transverse Mercator (fixed values)
RADIUS, FLATTENING, SCALE, EASTING = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0
_N = FLATTENING / (2 - FLATTENING)
_A = RADIUS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280,
)
_DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630,
)
_E = 2 * math.sqrt(_N) / (1 + _N)


def _atanh(x: Column) -> Column:
    return F.log((1 + x) / (1 - x)) / 2


def to_utm(lon: Column, lat: Column, zone: int = 32) -> tuple[Column, Column]:
    """Easting and northing of the northern half, by Krüger's series to the fourth order."""
    phi, d = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(_atanh(F.sin(phi)) - _atanh(F.sin(phi) * _E) * _E)
    xi, eta = F.atan2(t, F.cos(d)), _atanh(F.sin(d) / F.sqrt(t * t + 1))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + F.cos(xi * 2 * j) * F.sinh(eta * 2 * j) * a
        y = y + F.sin(xi * 2 * j) * F.cosh(eta * 2 * j) * a
    return x * (SCALE * _A) + EASTING, y * (SCALE * _A)


def from_utm(east: Column, north: Column, zone: int = 32) -> tuple[Column, Column]:
    """Longitude and latitude, the inverse of ``to_utm``."""
    xi, eta = north / (SCALE * _A), (east - EASTING) / (SCALE * _A)
    x, y = eta, xi
    for j, b in enumerate(_BETA, 1):
        x = x - F.cos(xi * 2 * j) * F.sinh(eta * 2 * j) * b
        y = y - F.sin(xi * 2 * j) * F.cosh(eta * 2 * j) * b
    chi = F.asin(F.sin(y) / F.cosh(x))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + F.sin(chi * 2 * j) * d
    return F.degrees(F.atan2(F.sinh(x), F.cos(y))) + (zone * 6 - 183), F.degrees(phi)

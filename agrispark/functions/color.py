"""Grey, HSV and CIELAB channels of 8-bit colours as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: sRGB to XYZ under D65, rows of X, Y and Z, and the white point (fixed values).
XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
WHITE = (0.950456, 1.0, 1.088754)


def gray(r: Column, g: Column, b: Column) -> Column:
    return F.bround(r * 0.299 + g * 0.587 + b * 0.114).cast("int")


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in half degrees (0 for greys), saturation and value, 0..255, not rounded."""
    hi, lo = F.greatest(r, g, b).cast("double"), F.least(r, g, b).cast("double")
    d = hi - lo
    hue = F.when(d == 0, F.lit(0.0)).when(hi == r, (g - b) * 30 / d).when(hi == g, (b - r) * 30 / d + 60).otherwise((r - g) * 30 / d + 120)
    return F.when(hue < 0, hue + 180).otherwise(hue), F.when(hi == 0, F.lit(0.0)).otherwise(d * 255 / hi), hi


def green_mask(r: Column, g: Column, b: Column) -> Column:
    """1 where the hue is 35..85 half degrees and saturation and value are 40 or more."""
    h, s, v = hsv(r, g, b)
    return (F.bround(h).between(35, 85) & (F.bround(s) >= 40) & (v >= 40)).cast("int")


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIELAB scaled to 8 bits: L by 255/100, a and b moved by 128, not rounded."""

    def linear(c: Column) -> Column:
        u = c / 255.0
        return F.when(u > 0.04045, F.pow((u + 0.055) / 1.055, F.lit(2.4))).otherwise(u / 12.92)

    def cube(t: Column) -> Column:
        return F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(t * 7.787 + 16 / 116)

    rgb = [linear(c) for c in (r, g, b)]
    x, y, z = ((rgb[0] * m[0] + rgb[1] * m[1] + rgb[2] * m[2]) / w for m, w in zip(XYZ, WHITE, strict=True))
    fx, fy, fz = cube(x), cube(y), cube(z)
    return (fy * 116 - 16) * 2.55, (fx - fy) * 500 + 128, (fy - fz) * 200 + 128

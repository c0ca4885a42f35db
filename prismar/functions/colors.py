"""Colour conversions as column arithmetic: 8-bit sRGB, CIELAB (D65) on the 8-bit grid, grey."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: sRGB to XYZ (D65), the white point, and the inverse matrix.
TO_XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
WHITE = (0.950456, 1.0, 1.088754)
FROM_XYZ = ((3.240479, -1.53715, -0.498535), (-0.969256, 1.875991, 0.041556), (0.055648, -0.204043, 1.057311))


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def _linear(c: Column) -> Column:
    x = c / 255.0
    return F.when(x > 0.04045, F.pow((x + 0.055) / 1.055, F.lit(2.4))).otherwise(x / 12.92)


def rgb_to_lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """L in 0..100, a and b about -128..127, rounded on the 8-bit grid (L * 255 / 100, a + 128, b + 128)."""
    lin = [_linear(c) for c in (r, g, b)]
    f = []
    for row, white in zip(TO_XYZ, WHITE):
        t = sum(k * c for k, c in zip(row, lin)) / white
        f.append((t, F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(7.787 * t + 16 / 116)))
    (_, fx), (y, fy), (_, fz) = f
    light = F.when(y > 0.008856, 116 * fy - 16).otherwise(903.3 * y)
    grid = lambda c: clip(F.floor(c + 0.5), 0, 255)
    return grid(light * 255 / 100) * 100.0 / 255, grid(500 * (fx - fy) + 128) - 128.0, grid(200 * (fy - fz) + 128) - 128.0


def lab_to_rgb(light: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Inverse of the conversion, clipped to 0..255 and rounded."""
    fy = (light + 16) / 116
    xyz = []
    for f, white in ((fy + a / 500, WHITE[0]), (fy, WHITE[1]), (fy - b / 200, WHITE[2])):
        xyz.append(white * F.when(f > 6 / 29, f * f * f).otherwise((f - 16 / 116) / 7.787))
    out = []
    for row in FROM_XYZ:
        c = clip(sum(k * x for k, x in zip(row, xyz)), 0.0, 1.0)
        s = F.when(c > 0.0031308, 1.055 * F.pow(c, F.lit(1 / 2.4)) - 0.055).otherwise(12.92 * c)
        out.append(F.floor(s * 255 + 0.5).cast("double"))
    return tuple(out)


def gray(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b

"""Colour spaces as column expressions. Channels come in as 0..1 doubles.

Two families stay apart on purpose: `app` (hue in degrees, inverse transfer
clamped) and `engine` (hue in radians). They differ in one matrix coefficient.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The OKLab matrices (linear sRGB -> cone response, cube root -> Lab and back).
TO_LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
TO_LAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -1.0))
B_LAST = {"app": 0.8086757993, "engine": 0.8086757660}
FROM_LAB = ((1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.2914855480))
FROM_LMS = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010))


def dot(row: tuple, *cols: Column) -> Column:
    total = cols[0] * F.lit(float(row[0]))
    for weight, col in zip(row[1:], cols[1:], strict=True):
        total = total + col * F.lit(float(weight))
    return total


def unit(channel: str | Column) -> Column:
    """0..255 to 0..1."""
    return (F.col(channel) if isinstance(channel, str) else channel) / F.lit(255.0)


def to_linear(v: Column) -> Column:
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def from_linear(v: Column, clamp: bool = True) -> Column:
    out = F.when(v <= 0.0031308, v * 12.92).otherwise(F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / 2.4)) * 1.055 - 0.055)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0)) if clamp else out


def oklab(r: Column, g: Column, b: Column, half: str = "app") -> tuple[Column, Column, Column]:
    linear = [to_linear(v) for v in (r, g, b)]
    lms = [F.cbrt(dot(row, *linear)) for row in TO_LMS]
    last = (*TO_LAB[2][:2], -B_LAST[half])
    return dot(TO_LAB[0], *lms), dot(TO_LAB[1], *lms), dot(last, *lms)


def oklab_to_srgb(l: Column, a: Column, b: Column, clamp: bool = True) -> tuple[Column, Column, Column]:
    lms = [F.pow(dot(row, l, a, b), F.lit(3.0)) for row in FROM_LAB]
    return tuple(from_linear(dot(row, *lms), clamp) for row in FROM_LMS)


def chroma(a: Column, b: Column) -> Column:
    return F.sqrt(a * a + b * b)


def hue_degrees(a: Column, b: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(b, a)), F.lit(360.0))


def hue_distance(h1: Column, h2: Column) -> Column:
    d = F.abs(h1 - h2) % F.lit(360.0)
    return F.least(d, F.lit(360.0) - d)


def hue_difference(h1: Column, h2: Column) -> Column:
    """Signed, in radians."""
    return F.atan2(F.sin(h1 - h2), F.cos(h1 - h2))


def hue_confidence(c: Column) -> Column:
    return F.least(F.greatest(c / 0.05, F.lit(0.0)), F.lit(1.0))


def distance_sq(one: tuple, two: tuple) -> Column:
    parts = [(a - b) * (a - b) for a, b in zip(one, two, strict=True)]
    return parts[0] + parts[1] + parts[2]


def hex_of(r: Column, g: Column, b: Column) -> Column:
    """#RRGGBB from 0..1, half-even rounding, clamped."""

    def two(v: Column) -> Column:
        return F.lpad(F.hex(F.rint(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * 255).cast("long")), 2, "0")

    return F.concat(F.lit("#"), two(r), two(g), two(b))


def hex_channel(text: Column, k: int) -> Column:
    """Channel k of #RRGGBB as 0..1."""
    return F.conv(F.substring(text, 2 + 2 * k, 2), 16, 10).cast("double") / 255


def quant_key(v: Column, scale: float = 1e9) -> Column:
    """Half-away rounding to a long; what isn't finite is worst."""
    finite = ~F.isnan(v) & (F.abs(v) < F.lit(9.2e18 / scale))
    return F.when(finite, (F.signum(v) * F.floor(F.abs(v) * scale + 0.5)).cast("long")).otherwise(F.lit(2**63 - 1))


def robust(v: Column) -> Column:
    return v / (v + 0.25)


# ------------------------------------------------ other spaces (0..1 in) ----
def hsl(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in degrees, saturation and lightness in percent."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    light, span = (top + low) / 2, top - low
    return _hue(r, g, b, top, span), F.when(span == 0, 0.0).otherwise(span / (F.lit(1.0) - F.abs(light * 2 - 1))) * 100, light * 100


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    return _hue(r, g, b, top, top - low), F.when(top == 0, 0.0).otherwise((top - low) / top) * 100, top * 100


def _hue(r: Column, g: Column, b: Column, top: Column, span: Column) -> Column:
    turn = F.when(top == r, F.pmod((g - b) / span, F.lit(6.0))).when(top == g, (b - r) / span + 2).otherwise((r - g) / span + 4)
    return F.when(span == 0, 0.0).otherwise(turn * 60)


def cmyk(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column, Column]:
    k = F.lit(1.0) - F.greatest(r, g, b)
    part = lambda v: F.when(k >= 1, 0.0).otherwise((F.lit(1.0) - v - k) / (F.lit(1.0) - k))
    return part(r), part(g), part(b), k


# The D50 white point and the rows that take D50 XYZ to linear sRGB.
D50 = (0.3457 / 0.3585, 1.0, (1.0 - 0.3457 - 0.3585) / 0.3585)
FROM_XYZ_D50 = ((3.1341359569958707, -1.6173863321612538, -0.4906619460083532), (-0.978795502912089, 1.9161404236526823, 0.033442731161319486), (0.07195537988411677, -0.22897682641583285, 1.4053400641663395))


def lab_to_srgb(l: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    """CSS Lab, which refers to D50, as clamped sRGB."""
    low, slope = 216 / 24389, 24389 / 27
    fy = (l + 16) / 116
    cube = lambda f: F.when(f * f * f > low, f * f * f).otherwise((f * 116 - 16) / slope)
    xyz = [cube(f) * w for f, w in zip((fy + a / 500, fy, fy - b / 200), D50, strict=True)]
    return tuple(from_linear(dot(row, *xyz)) for row in FROM_XYZ_D50)


def lch_to_srgb(l: Column, c: Column, h: Column) -> tuple[Column, Column, Column]:
    return lab_to_srgb(l, *polar_to_lab(c, h))


def polar_to_lab(c: Column, degrees: Column) -> tuple[Column, Column]:
    """The two axes of a chroma and a hue in degrees."""
    return c * F.cos(F.radians(degrees)), c * F.sin(F.radians(degrees))

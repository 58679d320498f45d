"""Colour arithmetic as Column expressions.

Every function takes and returns Columns, so a whole chain stays inside one
generated stage. Triples are plain tuples of Columns; channel bytes are 0..255
integers, linear light is 0..1 doubles.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

Triple = tuple[Column, Column, Column]

# D65 white, sRGB matrices, Oklab matrices, luminance weights.
WHITE = (0.95047, 1.0, 1.08883)
RGB_TO_XYZ = (
    (0.4124564, 0.3575761, 0.1804375),
    (0.2126729, 0.7151522, 0.072175),
    (0.0193339, 0.119192, 0.9503041),
)
XYZ_TO_RGB = (
    (3.2404542, -1.5371385, -0.4985314),
    (-0.969266, 1.8760108, 0.041556),
    (0.0556434, -0.2040259, 1.0572252),
)
RGB_TO_LMS = (
    (0.4122214708, 0.5363325363, 0.0514459929),
    (0.2119034982, 0.6806995451, 0.1073969566),
    (0.0883024619, 0.2817188376, 0.6299787005),
)
LMS_TO_OKLAB = (
    (0.2104542553, 0.793617785, -0.0040720468),
    (1.9779984951, -2.428592205, 0.4505937099),
    (0.0259040371, 0.7827717662, -0.808675766),
)
OKLAB_TO_LMS = ((1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.291485548))
LMS_TO_RGB = (
    (4.0767416621, -3.3077115913, 0.2309699292),
    (-1.2684380046, 2.6097574011, -0.3413193965),
    (-0.0041960863, -0.7034186147, 1.707614701),
)
LUMA = (0.2126, 0.7152, 0.0722)
LIGHTNESS_SOURCES = ("luma", "lstar", "red", "green", "blue", "max", "min")
SPACES = ("rgb", "cmyk", "lab", "hsl", "ycbcr")


def num(v: float) -> Column:
    return F.lit(float(v))


def let(value: Column, body) -> Column:
    """Evaluates `value` once per row and hands it to `body`.

    Lambda bodies re-evaluate whatever they capture at every step, so anything
    costly that a fold needs is bound here first.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clamp01(v: Column) -> Column:
    return F.least(num(1), F.greatest(num(0), v))


def half_up(v: Column) -> Column:
    """Rounds halves towards plus infinity."""
    return F.floor(v + 0.5)


def weighted(weights, values: Triple) -> Column:
    return values[0] * float(weights[0]) + values[1] * float(weights[1]) + values[2] * float(weights[2])


def matrix(rows, values: Triple) -> Triple:
    a, b, c = (weighted(row, values) for row in rows)
    return a, b, c


# ---- hex ----


def hex_valid(text: Column) -> Column:
    return F.trim(text).rlike("^#?([0-9a-fA-F]{6}|[0-9a-fA-F]{3})$")


def hex_to_rgb(text: Column) -> Triple:
    """Bytes of a 3 or 6 digit hex colour; null where the text is not one."""
    digits = F.regexp_replace(F.trim(text), "^#", "")
    full = F.when(F.length(digits) == 3, F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
    value = F.when(hex_valid(text), F.conv(full, 16, 10).cast("int"))
    rgb = let(value, lambda v: F.array(F.shiftright(v, 16).bitwiseAND(255), F.shiftright(v, 8).bitwiseAND(255), v.bitwiseAND(255)))
    return F.get(rgb, F.lit(0)), F.get(rgb, F.lit(1)), F.get(rgb, F.lit(2))


def rgb_to_hex(rgb: Triple) -> Column:
    r, g, b = (F.greatest(F.lit(0), F.least(F.lit(255), half_up(c.cast("double")).cast("int"))) for c in rgb)
    return F.concat(F.lit("#"), F.lpad(F.lower(F.hex((r * 65536 + g * 256 + b).cast("bigint"))), 6, "0"))


# ---- transfer ----


def _to_linear(v: float) -> float:
    return v / 12.92 if v <= 0.04045 else ((v + 0.055) / 1.055) ** 2.4


def srgb_to_linear(v: Column) -> Column:
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, num(2.4)))


def linear_to_srgb(v: Column) -> Column:
    c = clamp01(v)
    return F.when(c <= 0.0031308, c * 12.92).otherwise(F.pow(c, num(1 / 2.4)) * 1.055 - 0.055)


def constants(values, kind: str = "array<double>") -> Column:
    """A constant array as one small expression; the optimiser folds it to a literal before it runs."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def byte_to_linear(v: Column) -> Column:
    """Linear light of a channel byte, read from a 256-entry constant array instead of `pow`."""
    return F.get(constants([_to_linear(i / 255) for i in range(256)]), v)


def rgb_to_linear(rgb: Triple) -> Triple:
    r, g, b = (byte_to_linear(c) for c in rgb)
    return r, g, b


def linear_to_rgb(lin: Triple) -> Triple:
    r, g, b = (half_up(linear_to_srgb(c) * 255).cast("int") for c in lin)
    return r, g, b


# ---- Lab ----


def _lab_f(t: Column) -> Column:
    return F.when(t > 0.008856, F.cbrt(t)).otherwise(t * 7.787 + 16 / 116)


def lab_roots(lin: Triple) -> Triple:
    """What all three Lab values are made of; as columns of their own they are computed once."""
    x, y, z = matrix(RGB_TO_XYZ, lin)
    return _lab_f(x / WHITE[0]), _lab_f(y / WHITE[1]), _lab_f(z / WHITE[2])


def lab_of_roots(roots: Triple) -> Triple:
    fx, fy, fz = roots
    return fy * 116 - 16, (fx - fy) * 500, (fy - fz) * 200


def linear_to_lab(lin: Triple) -> Triple:
    return lab_of_roots(lab_roots(lin))


def rgb_to_lab(rgb: Triple) -> Triple:
    return linear_to_lab(rgb_to_linear(rgb))


def _lab_f_inv(t: Column) -> Column:
    return F.when(t > 0.206893, t * t * t).otherwise((t - 16 / 116) / 7.787)


def lab_to_linear(lab: Triple) -> Triple:
    l, a, b = lab
    fy = (l + 16) / 116
    xyz = (_lab_f_inv(fy + a / 500) * WHITE[0], _lab_f_inv(fy) * WHITE[1], _lab_f_inv(fy - b / 200) * WHITE[2])
    return matrix(XYZ_TO_RGB, xyz)


def lab_to_rgb(lab: Triple) -> Triple:
    return linear_to_rgb(lab_to_linear(lab))


def distance2(a: Triple, b: Triple) -> Column:
    d = [x - y for x, y in zip(a, b)]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def delta_e(a: Triple, b: Triple) -> Column:
    return F.sqrt(distance2(a, b))


def chroma(lab: Triple) -> Column:
    return F.sqrt(lab[1] * lab[1] + lab[2] * lab[2])


def hue_difference(a: Triple, b: Triple) -> Column:
    d = F.abs(F.atan2(a[2], a[1]) - F.atan2(b[2], b[1])) * (180 / math.pi)
    return F.when(d > 180, -d + 360).otherwise(d)


# ---- Oklab ----


def linear_to_oklab(lin: Triple) -> Triple:
    l, m, s = matrix(RGB_TO_LMS, lin)
    return matrix(LMS_TO_OKLAB, (F.cbrt(l), F.cbrt(m), F.cbrt(s)))


def oklab_to_linear(lab: Triple) -> Triple:
    l, m, s = matrix(OKLAB_TO_LMS, lab)
    return matrix(LMS_TO_RGB, (F.pow(l, num(3)), F.pow(m, num(3)), F.pow(s, num(3))))


def rgb_to_oklch(rgb: Triple) -> Triple:
    def polar(e: Column) -> Column:
        l, a, b = (F.get(e, F.lit(i)) for i in range(3))
        hue = F.degrees(F.atan2(b, a)) + 360
        return F.array(l, F.sqrt(a * a + b * b), F.when(hue >= 360, hue - 360).otherwise(hue))

    lab = let(F.array(*rgb_to_linear(rgb)), lambda e: F.array(*linear_to_oklab((F.get(e, F.lit(0)), F.get(e, F.lit(1)), F.get(e, F.lit(2))))))
    lch = let(lab, polar)
    return F.get(lch, F.lit(0)), F.get(lch, F.lit(1)), F.get(lch, F.lit(2))


def in_gamut(lin: Triple) -> Column:
    return F.forall(F.array(*lin), lambda v: (v >= -1e-4) & (v <= 1.0001))


def bisect(fits, lo: Column, hi: Column, steps: int) -> Column:
    """Largest value in [lo, hi] found to fit after `steps` halvings (lo is taken to fit).

    The state is one struct folded over a short constant sequence, so the search
    stays an expression of the row. `fits` should only read bound values (`let`).
    """

    def halve(state: Column) -> Column:
        mid = (state["lo"] + state["hi"]) / 2
        return F.when(fits(mid), F.struct(mid.alias("lo"), state["hi"].alias("hi"))).otherwise(F.struct(state["lo"].alias("lo"), mid.alias("hi")))

    def step(state: Column, _: Column) -> Column:
        return halve(state)

    start = F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)["lo"]


def _fit_srgb(l: np.ndarray, c: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Bytes of OKLCH colours as r * 65536 + g * 256 + b; each chroma shrinks (24 halvings) until its colour fits sRGB."""
    clamp = lambda v: np.where(np.isnan(v), 1.0, np.clip(v, 0, 1))
    l, c = clamp(l), np.maximum(0, c)
    cos, sin = np.cos(np.radians(h)), np.sin(np.radians(h))

    def linear(at, c: np.ndarray) -> list[np.ndarray]:
        lab = (l[at], c * cos[at], c * sin[at])
        lms = [v * v * v for v in (weighted(row, lab) for row in OKLAB_TO_LMS)]
        return [weighted(row, lms) for row in LMS_TO_RGB]

    def fits(lin: list[np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([(v >= -1e-4) & (v <= 1.0001) for v in lin])

    out = np.flatnonzero(~fits(linear(slice(None), c)))
    lo, hi = np.zeros(len(out)), c[out]
    for _ in range(24 if len(out) else 0):
        mid = (lo + hi) / 2
        fit = fits(linear(out, mid))
        lo, hi = np.where(fit, mid, lo), np.where(fit, hi, mid)
    c = c.copy()
    c[out] = lo
    light = [clamp(v) for v in linear(slice(None), c)]
    r, g, b = (np.floor(np.where(v <= 0.0031308, v * 12.92, np.power(v, 1 / 2.4) * 1.055 - 0.055) * 255 + 0.5).astype(np.int32) for v in light)
    return r * 65536 + g * 256 + b


def _fit_arrow(l: pa.Array, c: pa.Array, h: pa.Array) -> pa.Array:
    """Null lightness and chroma count as 0; without a hue the colour is black."""
    packed = _fit_srgb(*(pc.fill_null(v, 0.0).to_numpy(zero_copy_only=False) for v in (l, c, h)))
    return pc.if_else(pc.is_valid(h), pa.array(packed, pa.int32()), pa.scalar(0, pa.int32()))


def oklch_to_rgb(lch: Triple) -> Triple:
    """Bytes of an OKLCH colour; chroma shrinks (24 halvings) until the colour fits sRGB.

    The search runs over whole batches at once, and once for the three bytes. Not for use inside lambdas.
    """
    packed = F.arrow_udf(_fit_arrow, IntegerType())(*(v.cast("double") for v in lch))
    return F.shiftright(packed, 16), F.shiftright(packed, 8).bitwiseAND(255), packed.bitwiseAND(255)


# ---- adjustments ----


def luminance(lin: Triple) -> Column:
    return weighted(LUMA, lin)


def gamut_compress(lin: Triple) -> Triple:
    """Pulls an out-of-range colour towards its own luminance just enough to fit."""
    y = clamp01(luminance(lin))
    lo = F.least(*lin)
    t = F.when(lo < 0, y / F.greatest(y - lo, num(1e-6))).otherwise(num(1))
    lifted = tuple(F.when(lo < 0, y + (c - y) * t).otherwise(c) for c in lin)
    hi = F.greatest(*lifted)
    u = F.when(hi > 1, (num(1) - y) / F.greatest(hi - y, num(1e-6))).otherwise(num(1))
    r, g, b = (clamp01(F.when(hi > 1, y + (c - y) * u).otherwise(c)) for c in lifted)
    return r, g, b


def saturate(lin: Triple, amount: Column | float) -> Triple:
    """Saturation boost about luminance, in linear light (0 leaves the colour as it is)."""
    y = luminance(lin)
    k = (amount if isinstance(amount, Column) else num(amount)) + 1
    r, g, b = (clamp01(y + (c - y) * k) for c in lin)
    return r, g, b


def lightness(lin: Triple, source: str, srgb: Triple | None = None) -> Column:
    """Lightness 0..1 by one of LIGHTNESS_SOURCES."""
    if source == "lstar":
        y = luminance(tuple(clamp01(c) for c in lin))
        return F.when(y > 0.008856, F.pow(y, num(1 / 3)) * 116 - 16).otherwise(y * 903.3) / 100
    s = srgb or tuple(linear_to_srgb(c) for c in lin)
    if source == "luma":
        return weighted(LUMA, s)
    if source in ("red", "green", "blue"):
        return s[("red", "green", "blue").index(source)]
    if source == "max":
        return F.greatest(*s)
    if source == "min":
        return F.least(*s)
    raise ValueError(f"unknown lightness source {source}")


# ---- channel spaces (inputs are sRGB fractions unless named linear) ----


def hsl(s: Triple) -> Triple:
    """Hue in degrees, saturation and lightness 0..1."""
    r, g, b = s
    mx, mn = F.greatest(r, g, b), F.least(r, g, b)
    l, d = (mx + mn) * 0.5, mx - mn
    sat = F.when(d < 1e-5, num(0)).otherwise(d / F.greatest(num(1e-5), num(1) - F.abs(l * 2 - 1)))
    sector = (g - b) / d
    h = (
        F.when(d <= 1e-5, num(0))
        .when(mx == r, F.when(sector < 0, sector + 6).otherwise(sector))
        .when(mx == g, (b - r) / d + 2)
        .otherwise((r - g) / d + 4)
    )
    return h * 60, clamp01(sat), l


def cmyk(s: Triple, black: Column | float) -> tuple[Column, Column, Column, Column]:
    """CMYK with black generation: k is a share of the smallest of c, m and y."""
    c, m, y = (num(1) - v for v in s)
    k = F.least(c, m, y) * (black if isinstance(black, Column) else num(black))
    inks = [F.when(k < 0.999, (v - k) / (num(1) - k)).otherwise(num(0)) for v in (c, m, y)]
    return inks[0], inks[1], inks[2], k


def _halves(v: Column, scale: float) -> tuple[Column, Column]:
    return F.greatest(v, num(0)) * scale, F.greatest(-v, num(0)) * scale


def ycbcr(s: Triple, split: bool) -> list[Column]:
    y = weighted((0.299, 0.587, 0.114), s)
    cb, cr = (s[2] - y) / 1.772, (s[0] - y) / 1.402
    if split:
        return [num(1) - y, *_halves(cb, 2.0), *_halves(cr, 2.0)]
    return [num(1) - y, cb + 0.5, cr + 0.5]


def lab_channels(lin: Triple, split: bool, lab: Triple | None = None) -> list[Column]:
    l, a, b = lab or linear_to_lab(tuple(clamp01(c) for c in lin))
    first = num(1) - l / 100
    if split:
        return [first, *_halves(a / 90, 1.0), *_halves(b / 90, 1.0)]
    return [first, a / 180 + 0.5, b / 180 + 0.5]


def vivid(lab: Triple, amount: Column | float) -> Triple:
    """Moves a colour towards the most saturated one of its hue and lightness that sRGB holds."""
    share = amount if isinstance(amount, Column) else num(amount)
    bound = F.struct(lab[0].alias("l"), lab[1].alias("a"), lab[2].alias("b"), chroma(lab).alias("c"), share.alias("share"))

    def push(e: Column) -> Column:
        def at(k: Column) -> Triple:
            return e["l"], e["a"] / e["c"] * k, e["b"] / e["c"] * k

        move = (e["share"] > 0) & (e["c"] >= 3) & in_gamut(lab_to_linear((e["l"], e["a"], e["b"])))
        limit = bisect(lambda mid: in_gamut(lab_to_linear(at(mid))), e["c"], num(200), 24)
        pushed = let(e["c"] + (limit - e["c"]) * e["share"], lambda k: F.array(*at(k)))
        return F.when(move, pushed).otherwise(F.array(e["l"], e["a"], e["b"]))

    out = let(bound, push)
    return F.get(out, F.lit(0)), F.get(out, F.lit(1)), F.get(out, F.lit(2))


def multiply_blend(paper: Triple, inks: list[Triple], coverage: list[Column]) -> Triple:
    """Plain multiply blend of sRGB fractions, returned in linear light (comparison only)."""
    out = []
    for ch in range(3):
        v = paper[ch]
        for ink, c in zip(inks, coverage):
            v = v * (num(1) + (ink[ch] - 1) * clamp01(c))
        out.append(srgb_to_linear(v))
    return out[0], out[1], out[2]


# ---- dot gain ----

#: How strongly each paper soaks up ink.
ABSORBENCY = {"smooth": 0.6, "uncoated": 1.0, "recycled": 1.4}


def gain_amount(amount: Column | float, paper: str = "uncoated") -> Column:
    return (amount if isinstance(amount, Column) else num(amount)) * ABSORBENCY.get(paper, 1.0)


def dot_gain(c: Column, a: Column, curve: str = "midtone") -> Column:
    if curve == "midtone":
        return c + a * c * (num(1) - c) * 4
    return F.least(num(1), c * (a * 2 + 1))


def dot_gain_inverse(y: Column, a: Column, curve: str = "midtone") -> Column:
    if curve == "midtone":
        b = a * 4 + 1
        v = (b - F.sqrt(F.greatest(num(0), b * b - a * y * 16))) / (a * 8)
    else:
        v = y / (a * 2 + 1)
    return F.when(a <= 0, y).otherwise(v)

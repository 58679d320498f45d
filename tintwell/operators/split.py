"""Colour splitting: pixels to ink coverage.

Settings that are the same for every pixel become literals, so a whole method is
one projection. Settings that differ by image come in as tables and are joined
on the image's key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tintwell.functions import color as C
from tintwell.functions.color import Triple, clamp01, half_up, num
from tintwell.operators.curves import read_array

MAX_INKS = 4
CHANNELS = 5


def coverage_columns() -> list[Column]:
    return [F.col(f"c{k}") for k in range(MAX_INKS)]


def curve_tables(curves: DataFrame, keys: list[str]) -> DataFrame:
    """Per-ink tables given as rows (keys, ink, i, v) as one array per ink: keys, t0..t3. Inks without a table have null."""
    entries = lambda k: F.array_sort(F.collect_list(F.when(F.col("ink") == k, F.struct("i", "v"))))
    arrays = [F.transform(entries(k), lambda e: e["v"]) for k in range(MAX_INKS)]
    return curves.groupBy(*keys).agg(*[F.when(F.size(a) > 0, a).alias(f"t{k}") for k, a in enumerate(arrays)])


def tone_map(pixels: DataFrame, tables: DataFrame, keys: list[str], source: str = "luma") -> DataFrame:
    """Lightness through each ink's table, quantised to bytes: pixels' columns plus c0..c3, 0 where there is no table.

    `tables` holds one row per key, so the pixels join once on it: keys and arrays t0..t3 (`curves.band_tables`), or
    keys, ink, i, v (`curve_tables` makes arrays of them).
    """
    if "t0" not in tables.columns:
        tables = curve_tables(tables, keys)
    # Only the entries that a pixel reads are cut to bytes.
    coarse = lambda v: half_up(v * 255) / 255.0
    srgb = tuple(F.col(c) / 255.0 for c in "rgb")
    lin = C.rgb_to_linear((F.col("r"), F.col("g"), F.col("b")))
    at = pixels.withColumn("_x", C.lightness(lin, source, srgb))
    joined = at.join(tables.select(*keys, *[F.col(f"t{k}").alias(f"_t{k}") for k in range(MAX_INKS)]), keys, "left")
    return joined.select(*pixels.columns, *[F.coalesce(read_array(F.col(f"_t{k}"), F.col("_x"), each=coarse), num(0)).alias(f"c{k}") for k in range(MAX_INKS)])


def with_spaces(pixels: DataFrame, srgb: Triple, lin: Triple) -> DataFrame:
    """Adds the Lab and HSL values of a pixel as columns lab_l, lab_a, lab_b, hue, sat, light, so that `channels` can share them."""
    roots = C.lab_roots(tuple(clamp01(c) for c in lin))
    h, s, l = C.hsl(srgb)
    staged = pixels.select("*", *[c.alias(f"_f{i}") for i, c in enumerate(roots)], h.alias("hue"), s.alias("sat"), l.alias("light"))
    lab = C.lab_of_roots(tuple(F.col(f"_f{i}") for i in range(3)))
    return staged.select("*", *[c.alias(f"lab_{n}") for c, n in zip(lab, "lab")]).drop("_f0", "_f1", "_f2")


def channels(srgb: Triple, lin: Triple, space: str, split: bool = True, black: float = 0.5, lab: Triple | None = None, hsl: Triple | None = None) -> list[Column]:
    """Five channel values of a colour space; unused ones are 0. `lab` and `hsl` are used where they are at hand."""
    if space == "rgb":
        out = [num(1) - c for c in srgb]
    elif space == "cmyk":
        out = list(C.cmyk(srgb, black))
    elif space == "lab":
        out = C.lab_channels(lin, split, lab)
    elif space == "hsl":
        h, s, l = hsl or C.hsl(srgb)
        out = [h / 360, s, num(1) - l]
    elif space == "ycbcr":
        out = C.ycbcr(srgb, split)
    else:
        raise ValueError(f"unknown colour space {space}")
    return out + [num(0)] * (CHANNELS - len(out))


@dataclass(frozen=True)
class Route:
    """One channel sent to one ink."""

    channel: int
    ink: int
    gain: float = 1.0
    opacity: float = 1.0


def route(values: list[Column], routes: list[Route], blend: str = "add", ink_count: int = MAX_INKS) -> list[Column]:
    """Coverage of four inks from routed channels, merged by add, max, average or screen."""
    out = []
    for ink in range(MAX_INKS):
        parts = [clamp01(values[r.channel] * r.gain) * r.opacity for r in routes if r.ink == ink] if ink < ink_count else []
        if not parts:
            merged = num(0)
        elif blend == "max":
            merged = F.greatest(*parts, num(0))
        elif blend == "screen":
            bare = num(1)
            for p in parts:
                bare = bare * (num(1) - p)
            merged = num(1) - bare
        else:
            total = parts[0]
            for p in parts[1:]:
                total = total + p
            merged = total / float(len(parts)) if blend == "average" else total
        out.append(clamp01(merged))
    return out


def matrix_from_routes(routes: list[Route]) -> list[list[float]]:
    """Mixer rows (four inks by five weights and an offset) that start from a routing."""
    rows = [[0.0] * (CHANNELS + 1) for _ in range(MAX_INKS)]
    for r in routes:
        rows[r.ink][r.channel] = int(r.gain * r.opacity * 100 + 0.5) / 100
    return rows


def mix_channels(values: list[Column], matrix: list[list[float]], ink_count: int = MAX_INKS) -> list[Column]:
    out = []
    for ink in range(MAX_INKS):
        total = num(matrix[ink][CHANNELS])
        for c in range(CHANNELS):
            if matrix[ink][c]:
                total = total + values[c] * float(matrix[ink][c])
        out.append(clamp01(total) if ink < ink_count else num(0))
    return out


@dataclass(frozen=True)
class ColorRange:
    """A colour range: hue and width in degrees, limits and feather in 0..1, target ink."""

    hue: float
    width: float = 40.0
    sat_min: float = 0.2
    sat_max: float = 1.0
    light_min: float = 0.05
    light_max: float = 0.95
    feather: float = 0.3
    ink: int = 0


def smoothstep(lo: float, hi: float, x: Column) -> Column:
    t = clamp01((x - lo) / (hi - lo))
    return t * t * (num(3) - t * 2)


def _band(x: Column, lo: float, hi: float, soft: float) -> Column:
    if soft <= 0:
        return F.when((x >= lo) & (x <= hi), num(1)).otherwise(num(0))
    return smoothstep(lo - soft, lo, x) * (num(1) - smoothstep(hi, hi + soft, x))


def membership(hsl: Triple, r: ColorRange) -> Column:
    """How much a colour belongs to a range, 0..1 (wrapped hue distance, feathered limits)."""
    h, s, l = hsl
    turned = h - r.hue + 180
    away = F.abs(turned - F.floor(turned / 360) * 360 - 180)
    half = r.width * 0.5
    if r.feather <= 0:
        near = F.when(away <= half, num(1)).otherwise(num(0))
    else:
        near = num(1) - smoothstep(half, half + r.feather * 60, away)
    return near * _band(s, r.sat_min, r.sat_max, r.feather * 0.25) * _band(l, r.light_min, r.light_max, r.feather * 0.25)


def selective(hsl: Triple, ranges: list[ColorRange], source: str = "saturation", base: Column | int | None = None, ink_count: int = MAX_INKS) -> list[Column]:
    """Coverage of four inks from colour ranges; everything else goes to the base ink as a gray."""
    amount = {"saturation": hsl[1], "lightness": num(1) - hsl[2], "constant": num(1)}[source]
    shares = [membership(hsl, r) for r in ranges]
    selected = F.greatest(num(0), num(0), *shares)
    rest = (num(1) - selected) * (num(1) - hsl[2])
    out = []
    for ink in range(MAX_INKS):
        parts = [m * amount for m, r in zip(shares, ranges) if r.ink == ink]
        v = F.greatest(num(0), num(0), *parts)
        if base is not None:
            v = F.when(base == ink, F.greatest(v, rest)).otherwise(v) if isinstance(base, Column) else (F.greatest(v, rest) if base == ink else v)
        out.append(clamp01(v) if ink < ink_count else num(0))
    return out


def range_from_color(hsl: Triple) -> dict[str, Column]:
    """Range around a picked colour: its hue, and limits 35 points around its saturation and lightness."""
    h, s, l = hsl
    return {
        "hue": half_up(h).cast("int"),
        "width": F.lit(40),
        "sat_min": F.greatest(F.lit(0), half_up(s * 100 - 35).cast("int")),
        "sat_max": F.lit(100),
        "light_min": F.greatest(F.lit(0), half_up(l * 100 - 35).cast("int")),
        "light_max": F.least(F.lit(100), half_up(l * 100 + 35).cast("int")),
    }


def darkest_ink(inks: DataFrame, keys: list[str]) -> DataFrame:
    """Slot of the darkest ink of every palette (the earlier one on a tie): keys, ink."""
    l = C.rgb_to_lab(C.hex_to_rgb(F.col("hex")))[0]
    return inks.groupBy(*keys).agg(F.min_by("ink", F.struct(l.alias("l"), F.col("ink"))).alias("ink"))


def detail_split(pixels: DataFrame, blurred: DataFrame, base: DataFrame, detail_ink: int, mode: str, contrast: float, threshold: float, edges: DataFrame | None = None) -> DataFrame:
    """Fine detail screened into one ink over a base split of the blurred image.

    `pixels` and `blurred`: image_id, x, y, luma (sRGB). `base`: image_id, x, y,
    c0..c3 made from the blurred image. `edges` (mode "edges"): image_id, x, y,
    gx, gy of the luma.
    """
    key = ["image_id", "x", "y"]
    joined = pixels.select(*key, "luma").join(blurred.select(*key, F.col("luma").alias("_soft")), key).join(base.select(*key, *coverage_columns()), key)
    if mode == "edges":
        joined = joined.join(edges.select(*key, "gx", "gy"), key)
    d = detail(mode, contrast, threshold, F.col("luma"), F.col("_soft"), F.col("gx") if edges is not None else None, F.col("gy") if edges is not None else None)
    out = [screened(F.col(f"c{k}"), d).alias(f"c{k}") if k == detail_ink else F.col(f"c{k}") for k in range(MAX_INKS)]
    return joined.select(*key, *out)


def detail(mode: str, contrast: float, threshold: float, sharp: Column, soft: Column, gx: Column | None = None, gy: Column | None = None) -> Column:
    """Share of fine detail of a pixel: darker than its blur (highpass, lineart), or the strength of its gradient (edges)."""
    if mode == "edges":
        return clamp01(F.sqrt(gx * gx + gy * gy) * (contrast * 2) - threshold)
    diff = (soft - sharp) * contrast * 8.0
    return clamp01(smoothstep(threshold, threshold + 0.06, diff) if mode == "lineart" else diff - threshold)


def screened(cover: Column, d: Column) -> Column:
    """Coverage with detail printed over it."""
    return num(1) - (num(1) - cover) * (num(1) - d)

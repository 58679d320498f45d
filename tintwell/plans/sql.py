"""Pieces of SQL text that the comparison queries share."""

from __future__ import annotations

from tintwell.functions import color as C


def lin(v: str) -> str:
    """Linear light of an sRGB fraction."""
    return f"(CASE WHEN {v} <= 0.04045 THEN {v} / 12.92 ELSE pow(({v} + 0.055) / 1.055, 2.4) END)"


def lin_byte(v: str) -> str:
    return lin(f"({v} / 255.0::DOUBLE)")


def clamp01(v: str) -> str:
    return f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {v}))"


def srgb(v: str) -> str:
    c = clamp01(v)
    return f"(CASE WHEN {c} <= 0.0031308 THEN {c} * 12.92 ELSE 1.055 * pow({c}, 1.0::DOUBLE / 2.4) - 0.055 END)"


def byte(v: str) -> str:
    return f"CAST(floor({srgb(v)} * 255 + 0.5) AS INTEGER)"


def dot(row, a: str, b: str, c: str) -> str:
    return f"({row[0]!r}::DOUBLE * {a} + {row[1]!r}::DOUBLE * {b} + {row[2]!r}::DOUBLE * {c})"


def lab_f(t: str) -> str:
    return f"(CASE WHEN {t} > 0.008856 THEN cbrt({t}) ELSE 7.787 * ({t}) + 16.0::DOUBLE / 116 END)"


def lab_inv(t: str) -> str:
    return f"(CASE WHEN {t} > 0.206893 THEN ({t}) * ({t}) * ({t}) ELSE (({t}) - 16.0::DOUBLE / 116) / 7.787 END)"


def hex_bytes(h: str) -> str:
    """r, g and b columns of a six-digit hex colour."""
    return ", ".join(f"CAST('0x' || substr({h}, {at}, 2) AS INTEGER) AS {name}" for name, at in (("r", 2), ("g", 4), ("b", 6)))


def to_hex(r: str, g: str, b: str) -> str:
    return f"printf('#%02x%02x%02x', {r}, {g}, {b})"


def linear_cte(name: str, src: str) -> str:
    """Adds lr, lg and lb to a table with byte columns r, g and b."""
    return f"{name} AS (SELECT *, {lin_byte('r')} AS lr, {lin_byte('g')} AS lg, {lin_byte('b')} AS lb FROM {src})"


def lab_cte(name: str, src: str) -> str:
    """Adds lab_l, lab_a and lab_b to a table with lr, lg and lb."""
    x, y, z = (dot(row, "lr", "lg", "lb") for row in C.RGB_TO_XYZ)
    return f"""{name} AS (SELECT * EXCLUDE (fx, fy, fz), 116 * fy - 16 AS lab_l, 500 * (fx - fy) AS lab_a, 200 * (fy - fz) AS lab_b
  FROM (SELECT *, {lab_f(x + " / 0.95047")} AS fx, {lab_f(y)} AS fy, {lab_f(z + " / 1.08883")} AS fz FROM {src}) t)"""


def oklab_cte(name: str, src: str) -> str:
    """Adds ok_l, ok_c and ok_h (degrees) to a table with lr, lg and lb."""
    l, m, s = (f"cbrt({dot(row, 'lr', 'lg', 'lb')})" for row in C.RGB_TO_LMS)
    return f"""{name} AS (SELECT * EXCLUDE (q0, q1, q2), sqrt(q1 * q1 + q2 * q2) AS ok_c, q0 AS ok_l,
    CASE WHEN degrees(atan2(q2, q1)) + 360 >= 360 THEN degrees(atan2(q2, q1)) ELSE degrees(atan2(q2, q1)) + 360 END AS ok_h
  FROM (SELECT * EXCLUDE (l0, m0, s0), {dot(C.LMS_TO_OKLAB[0], 'l0', 'm0', 's0')} AS q0, {dot(C.LMS_TO_OKLAB[1], 'l0', 'm0', 's0')} AS q1,
        {dot(C.LMS_TO_OKLAB[2], 'l0', 'm0', 's0')} AS q2 FROM (SELECT *, {l} AS l0, {m} AS m0, {s} AS s0 FROM {src}) t) u)"""


def oklch_linear(l: str, c: str, h: str) -> list[str]:
    """Linear r, g and b expressions of an OKLCH colour (l in 0..1, h in degrees)."""
    a, b = f"({c} * cos(radians({h})))", f"({c} * sin(radians({h})))"
    lms = [f"pow({dot(row, l, a, b)}, 3)" for row in C.OKLAB_TO_LMS]
    return [dot(row, *lms) for row in C.LMS_TO_RGB]


def in_gamut(rgb: list[str]) -> str:
    return f"(least({', '.join(rgb)}) >= -1e-4 AND greatest({', '.join(rgb)}) <= 1.0001)"


def fit_oklch_ctes(name: str, src: str, keys: str, l: str = "l", c: str = "c", h: str = "h") -> str:
    """Recursive chroma fit of `src(keys, l, c, h)`; the result table adds byte columns r, g, b."""
    test = in_gamut(oklch_linear("l", "mid", "h"))
    full = in_gamut(oklch_linear("l", "c", "h"))
    out = oklch_linear("l", "cc", "h")
    return f"""{name}_in AS (SELECT {keys}, {clamp01(l)} AS l, greatest(0.0::DOUBLE, {c}) AS c, {h} AS h FROM {src}),
{name}_search AS (
  SELECT {keys}, l, c, h, 0 AS step, 0.0::DOUBLE AS lo, c AS hi FROM {name}_in
  UNION ALL
  SELECT {keys}, l, c, h, step + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END
  FROM (SELECT *, {test} AS ok FROM (SELECT *, (lo + hi) / 2 AS mid FROM {name}_search WHERE step < 24) a) b),
{name}_fit AS (SELECT {keys}, l, h, CASE WHEN {full} THEN c ELSE lo END AS cc FROM {name}_search WHERE step = 24),
{name} AS (SELECT {keys}, {byte('x')} AS r, {byte('y')} AS g, {byte('z')} AS b
  FROM (SELECT {keys}, {out[0]} AS x, {out[1]} AS y, {out[2]} AS z FROM {name}_fit) t)"""


def hsl_cte(name: str, src: str) -> str:
    """Adds hue (degrees), sat and light to a table with sRGB fractions sr, sg and sb."""
    return f"""{name} AS (SELECT * EXCLUDE (mx, mn), (mx + mn) * 0.5 AS light,
    CASE WHEN mx - mn < 1e-5 THEN 0.0::DOUBLE ELSE {clamp01("(mx - mn) / greatest(1e-5, 1 - abs(2 * ((mx + mn) * 0.5) - 1))")} END AS sat,
    60 * CASE WHEN mx - mn <= 1e-5 THEN 0.0::DOUBLE
      WHEN mx = sr THEN CASE WHEN (sg - sb) / (mx - mn) < 0 THEN (sg - sb) / (mx - mn) + 6 ELSE (sg - sb) / (mx - mn) END
      WHEN mx = sg THEN (sb - sr) / (mx - mn) + 2 ELSE (sr - sg) / (mx - mn) + 4 END AS hue
  FROM (SELECT *, greatest(sr, sg, sb) AS mx, least(sr, sg, sb) AS mn FROM {src}) t)"""


def fractions_cte(name: str, src: str) -> str:
    return f"{name} AS (SELECT *, r / 255.0::DOUBLE AS sr, g / 255.0::DOUBLE AS sg, b / 255.0::DOUBLE AS sb FROM {src})"


LUMA = "(0.2126 * {0} + 0.7152 * {1} + 0.0722 * {2})"

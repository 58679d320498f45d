"""Colour functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tintwell.functions import color as C
from tintwell.functions import hashing, schemes, spectral
from tintwell.plans import sql as S
from tintwell.plans.registry import query
from tintwell.sources import bridge as B
from tintwell.session import read_table

KEYS = ["image_id", "order_key", "line"]
KEY_SQL = "image_id, order_key, line"


def r6(col, name: str, digits: int = 6):
    return F.round(col, digits).alias(name)


def rgb():
    return F.col("r"), F.col("g"), F.col("b")


def lin():
    return F.col("lr"), F.col("lg"), F.col("lb")


def fractions():
    return tuple(c / 255.0 for c in rgb())


def with_linear(df):
    lr, lg, lb = C.rgb_to_linear(rgb())
    return df.withColumns({"lr": lr, "lg": lg, "lb": lb})


@query(
    "c1_hex",
    B.ctes("palettes")
    + f""", t AS (SELECT *, {S.hex_bytes('hex')} FROM palettes)
SELECT palette_id, ink, r, g, b, {S.to_hex('r', 'g', 'b')} AS hex_back,
  CAST(('0x' || substr(hex, 2, 1))::INTEGER * 17 AS INTEGER) AS short_r, CAST(NULL AS INTEGER) AS bad FROM t""",
)
def c1_hex(spark, folder):
    p = B.palettes(spark, folder)
    r, g, b = C.hex_to_rgb(F.upper("hex"))
    short = C.hex_to_rgb(F.concat(F.lit(" "), F.substring("hex", 2, 3), F.lit(" ")))
    bad = C.hex_to_rgb(F.concat("hex", F.lit("z")))[0]
    return p.select("palette_id", "ink", r.alias("r"), g.alias("g"), b.alias("b"), C.rgb_to_hex((r, g, b)).alias("hex_back"), short[0].alias("short_r"), bad.alias("bad"))


@query(
    "c2_transfer",
    B.ctes("flat_px")
    + f""", {S.linear_cte('t', 'flat_px')}
SELECT {KEY_SQL}, round(lr, 6) AS lr, round(lg, 6) AS lg, round(lb, 6) AS lb, {S.byte('lr')} AS back_r, {S.byte('lg')} AS back_g, {S.byte('lb')} AS back_b FROM t""",
)
def c2_transfer(spark, folder):
    px = with_linear(B.flat_px(spark, folder))
    br, bg, bb = C.linear_to_rgb(lin())
    return px.select(*KEYS, r6("lr", "lr"), r6("lg", "lg"), r6("lb", "lb"), br.alias("back_r"), bg.alias("back_g"), bb.alias("back_b"))


_FY = "((lab_l + 16) / 116)"
_XYZ = [f"0.95047 * {S.lab_inv(_FY + ' + lab_a / 500')}", S.lab_inv(_FY), f"1.08883 * {S.lab_inv(_FY + ' - lab_b / 200')}"]


@query(
    "c3_lab",
    B.ctes("flat_px")
    + f""", {S.linear_cte('t', 'flat_px')}, {S.lab_cte('u', 't')},
v AS (SELECT *, {_XYZ[0]} AS cx, {_XYZ[1]} AS cy, {_XYZ[2]} AS cz FROM u),
w AS (SELECT *, {S.dot(C.XYZ_TO_RGB[0], 'cx', 'cy', 'cz')} AS br, {S.dot(C.XYZ_TO_RGB[1], 'cx', 'cy', 'cz')} AS bg, {S.dot(C.XYZ_TO_RGB[2], 'cx', 'cy', 'cz')} AS bb FROM v)
SELECT {KEY_SQL}, round(lab_l, 6) AS l, round(lab_a, 6) AS a, round(lab_b, 6) AS b, {S.byte('br')} AS back_r, {S.byte('bg')} AS back_g, {S.byte('bb')} AS back_b FROM w""",
)
def c3_lab(spark, folder):
    l, a, b = C.rgb_to_lab(rgb())
    px = B.flat_px(spark, folder).select(*KEYS, l.alias("l"), a.alias("a"), b.alias("b"))
    br, bg, bb = C.lab_to_rgb((F.col("l"), F.col("a"), F.col("b")))
    return px.select(*KEYS, r6("l", "l"), r6("a", "a"), r6("b", "b"), br.alias("back_r"), bg.alias("back_g"), bb.alias("back_b"))


PAPER = (0xF6, 0xF3, 0xEC)


@query(
    "c4_delta_e",
    B.ctes("rgb21")
    + f""", {S.linear_cte('t', 'rgb21')}, {S.lab_cte('u', 't')},
paper AS (SELECT {PAPER[0]} AS r, {PAPER[1]} AS g, {PAPER[2]} AS b), {S.linear_cte('p1', 'paper')}, {S.lab_cte('p2', 'p1')},
d AS (SELECT image_id, pow(u.lab_l - p2.lab_l, 2) + pow(u.lab_a - p2.lab_a, 2) + pow(u.lab_b - p2.lab_b, 2) AS d2 FROM u, p2)
SELECT image_id, round(avg(sqrt(d2)), 6) AS mean_de, round(max(d2), 4) AS max_d2, count(*) AS n FROM d GROUP BY image_id""",
)
def c4_delta_e(spark, folder):
    px = B.rgb21(spark, folder)
    lab = C.rgb_to_lab(rgb())
    paper = C.rgb_to_lab(tuple(F.lit(v) for v in PAPER))
    d = px.select("image_id", C.distance2(lab, paper).alias("d2"))
    return d.groupBy("image_id").agg(r6(F.avg(F.sqrt("d2")), "mean_de"), r6(F.max("d2"), "max_d2", 4), F.count("*").alias("n"))


@query(
    "c5_oklch",
    B.ctes("flat_px")
    + f""", {S.linear_cte('t', 'flat_px')}, {S.oklab_cte('u', 't')}
SELECT {KEY_SQL}, round(ok_l, 6) AS l, round(ok_c, 6) AS c, CASE WHEN ok_c > 1e-3 THEN round(ok_h, 4) END AS h FROM u""",
)
def c5_oklch(spark, folder):
    l, c, h = C.rgb_to_oklch(rgb())
    px = B.flat_px(spark, folder).select(*KEYS, l.alias("l"), c.alias("c"), h.alias("h"))
    return px.select(*KEYS, r6("l", "l"), r6("c", "c"), F.when(F.col("c") > 1e-3, F.round("h", 4)).alias("h"))


@query(
    "c5_gamut_fit",
    B.ctes("palettes").replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", t0 AS (SELECT palette_id, ink, {S.hex_bytes('hex')} FROM palettes), {S.linear_cte('t1', 't0')}, {S.oklab_cte('t2', 't1')},
t3 AS (SELECT palette_id, ink, ok_l + 0.1 AS l, ok_c + 0.15 AS c, ok_h AS h FROM t2 WHERE ok_c > 1e-3),
{S.fit_oklch_ctes('f', 't3', 'palette_id, ink')}
SELECT palette_id, ink, {S.to_hex('r', 'g', 'b')} AS hex FROM f""",
)
def c5_gamut_fit(spark, folder):
    l, c, h = C.rgb_to_oklch(C.hex_to_rgb(F.col("hex")))
    p = B.palettes(spark, folder).select("palette_id", "ink", l.alias("l"), c.alias("c"), h.alias("h")).where(F.col("c") > 1e-3)
    return p.select("palette_id", "ink", C.rgb_to_hex(C.oklch_to_rgb((F.col("l") + 0.1, F.col("c") + 0.15, F.col("h")))).alias("hex"))


_Y = S.LUMA.format("lr", "lg", "lb")


@query(
    "c6_gamut_compress",
    B.ctes("flat_px")
    + f""", {S.linear_cte('t', 'flat_px')},
wide AS (SELECT {KEY_SQL}, {_Y} + (lr - {_Y}) * 2.5 AS xr, {_Y} + (lg - {_Y}) * 2.5 AS xg, {_Y} + (lb - {_Y}) * 2.5 AS xb FROM t),
a AS (SELECT *, {S.clamp01(S.LUMA.format('xr', 'xg', 'xb'))} AS y, least(xr, xg, xb) AS lo FROM wide),
b AS (SELECT {KEY_SQL}, y, {", ".join(f"CASE WHEN lo < 0 THEN y + ({c} - y) * (y / greatest(y - lo, 1e-6)) ELSE {c} END AS {c}" for c in ("xr", "xg", "xb"))} FROM a),
c AS (SELECT *, greatest(xr, xg, xb) AS hi FROM b)
SELECT {KEY_SQL}, {", ".join("round(" + S.clamp01(f"CASE WHEN hi > 1 THEN y + (x{c} - y) * ((1 - y) / greatest(hi - y, 1e-6)) ELSE x{c} END") + f", 6) AS {c}" for c in "rgb")} FROM c""",
)
def c6_gamut_compress(spark, folder):
    px = with_linear(B.flat_px(spark, folder))
    y = C.luminance(lin())
    wide = px.select(*KEYS, *[(y + (c - y) * 2.5).alias(n) for c, n in zip(lin(), ("xr", "xg", "xb"))])
    r, g, b = C.gamut_compress((F.col("xr"), F.col("xg"), F.col("xb")))
    return wide.select(*KEYS, r6(r, "r"), r6(g, "g"), r6(b, "b"))


_LSTAR = "(CASE WHEN {y} > 0.008856 THEN 116 * pow({y}, 1.0::DOUBLE / 3) - 16 ELSE 903.3 * {y} END) / 100".format(y=_Y)


@query(
    "c7_lightness",
    B.ctes("flat_px")
    + f""", {S.linear_cte('l0', 'flat_px')}, {S.fractions_cte('t', 'l0')}
SELECT {KEY_SQL}, round({S.LUMA.format('sr', 'sg', 'sb')}, 6) AS luma, round({_LSTAR}, 6) AS lstar, round(sr, 6) AS red, round(sg, 6) AS green,
  round(sb, 6) AS blue, round(greatest(sr, sg, sb), 6) AS max, round(least(sr, sg, sb), 6) AS min FROM t""",
)
def c7_lightness(spark, folder):
    px = with_linear(B.flat_px(spark, folder))
    return px.select(*KEYS, *[r6(C.lightness(lin(), s, fractions()), s) for s in C.LIGHTNESS_SOURCES])


@query(
    "c8_hsl",
    B.ctes("flat_px")
    + f""", {S.fractions_cte('t', 'flat_px')}, {S.hsl_cte('u', 't')}
SELECT {KEY_SQL}, round(hue, 6) AS hue, round(sat, 6) AS sat, round(light, 6) AS light FROM u""",
)
def c8_hsl(spark, folder):
    h, s, l = C.hsl(fractions())
    return B.flat_px(spark, folder).select(*KEYS, r6(h, "hue"), r6(s, "sat"), r6(l, "light"))


@query(
    "c9_cmyk",
    B.ctes("flat_px")
    + f""", {S.fractions_cte('t', 'flat_px')}, u AS (SELECT *, least(1 - sr, 1 - sg, 1 - sb) * 0.5 AS k FROM t)
SELECT {KEY_SQL}, {", ".join(f"round(CASE WHEN k < 0.999 THEN (1 - s{c} - k) / (1 - k) ELSE 0 END, 6) AS {n}" for c, n in zip("rgb", "cmy"))}, round(k, 6) AS k FROM u""",
)
def c9_cmyk(spark, folder):
    c, m, y, k = C.cmyk(fractions(), 0.5)
    return B.flat_px(spark, folder).select(*KEYS, r6(c, "c"), r6(m, "m"), r6(y, "y"), r6(k, "k"))


@query(
    "c10_ycbcr",
    B.ctes("flat_px")
    + f""", {S.fractions_cte('t', 'flat_px')}, u AS (SELECT *, 0.299 * sr + 0.587 * sg + 0.114 * sb AS yy FROM t),
v AS (SELECT *, (sb - yy) / 1.772 AS cb, (sr - yy) / 1.402 AS cr FROM u)
SELECT {KEY_SQL}, round(1 - yy, 6) AS h0, round(greatest(cb, 0) * 2, 6) AS h1, round(greatest(-cb, 0) * 2, 6) AS h2, round(greatest(cr, 0) * 2, 6) AS h3,
  round(greatest(-cr, 0) * 2, 6) AS h4, round(0.5 + cb, 6) AS s1, round(0.5 + cr, 6) AS s2 FROM v""",
)
def c10_ycbcr(spark, folder):
    split, signed = C.ycbcr(fractions(), True), C.ycbcr(fractions(), False)
    return B.flat_px(spark, folder).select(*KEYS, *[r6(c, f"h{i}") for i, c in enumerate(split)], r6(signed[1], "s1"), r6(signed[2], "s2"))


@query(
    "c11_lab_channels",
    B.ctes("flat_px")
    + f""", {S.linear_cte('t', 'flat_px')}, {S.lab_cte('u', 't')}
SELECT {KEY_SQL}, round(1 - lab_l / 100, 6) AS h0, round(greatest(lab_a, 0) / 90, 6) AS h1, round(greatest(-lab_a, 0) / 90, 6) AS h2,
  round(greatest(lab_b, 0) / 90, 6) AS h3, round(greatest(-lab_b, 0) / 90, 6) AS h4, round(0.5 + lab_a / 180, 6) AS s1, round(0.5 + lab_b / 180, 6) AS s2 FROM u""",
)
def c11_lab_channels(spark, folder):
    px = with_linear(B.flat_px(spark, folder))
    split, signed = C.lab_channels(lin(), True), C.lab_channels(lin(), False)
    return px.select(*KEYS, *[r6(c, f"h{i}") for i, c in enumerate(split)], r6(signed[1], "s1"), r6(signed[2], "s2"))


@query(
    "c12_chroma_hue",
    B.ctes("flat_px")
    + f""", {S.linear_cte('t', 'flat_px')}, {S.lab_cte('u', 't')},
turned AS (SELECT {KEY_SQL}, lab_a AS a1, lab_b AS b1, lg AS lr, lb AS lg, lr AS lb FROM u), {S.lab_cte('u2', 'turned')},
j AS (SELECT {KEY_SQL}, a1, b1, lab_a AS a2, lab_b AS b2 FROM u2),
k AS (SELECT *, sqrt(a1 * a1 + b1 * b1) AS c1, sqrt(a2 * a2 + b2 * b2) AS c2, abs(atan2(b1, a1) - atan2(b2, a2)) * (180 / pi()) AS d FROM j)
SELECT {KEY_SQL}, round(c1, 6) AS chroma, CASE WHEN c1 > 1 AND c2 > 1 THEN round(CASE WHEN d > 180 THEN 360 - d ELSE d END, 4) END AS hue_diff FROM k""",
)
def c12_chroma_hue(spark, folder):
    px = with_linear(B.flat_px(spark, folder))
    x, y = C.linear_to_lab(lin()), C.linear_to_lab((lin()[1], lin()[2], lin()[0]))
    known = (C.chroma(x) > 1) & (C.chroma(y) > 1)
    return px.select(*KEYS, r6(C.chroma(x), "chroma"), F.when(known, F.round(C.hue_difference(x, y), 4)).alias("hue_diff"))


def _lab_lin(l: str, a: str, b: str) -> list[str]:
    fy = f"(({l} + 16) / 116)"
    xyz = [f"(0.95047 * {S.lab_inv(f'{fy} + {a} / 500')})", S.lab_inv(fy), f"(1.08883 * {S.lab_inv(f'{fy} - {b} / 200')})"]
    return [S.dot(row, *xyz) for row in C.XYZ_TO_RGB]


@query(
    "c13_vivid",
    B.ctes("palettes").replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", t0 AS (SELECT palette_id, ink, {S.hex_bytes('hex')} FROM palettes), {S.linear_cte('t1', 't0')}, {S.lab_cte('t2', 't1')},
t3 AS (SELECT palette_id, ink, lab_l AS l, lab_a AS a, lab_b AS b, sqrt(lab_a * lab_a + lab_b * lab_b) AS c FROM t2),
s AS (SELECT *, 0 AS step, c AS lo, 200.0::DOUBLE AS hi FROM t3 WHERE c >= 3 AND {S.in_gamut(_lab_lin('l', 'a', 'b'))}
  UNION ALL SELECT palette_id, ink, l, a, b, c, step + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END
  FROM (SELECT *, {S.in_gamut(_lab_lin('l', '(a / c * mid)', '(b / c * mid)'))} AS ok FROM (SELECT *, (lo + hi) / 2 AS mid FROM s WHERE step < 24) x) y)
SELECT t3.palette_id, t3.ink, round(t3.l, 5) AS l, round(CASE WHEN s.c IS NULL THEN t3.a ELSE t3.a / t3.c * (t3.c + (s.lo - t3.c) * 0.4) END, 4) AS a,
  round(CASE WHEN s.c IS NULL THEN t3.b ELSE t3.b / t3.c * (t3.c + (s.lo - t3.c) * 0.4) END, 4) AS b
FROM t3 LEFT JOIN (SELECT * FROM s WHERE step = 24) s USING (palette_id, ink)""",
)
def c13_vivid(spark, folder):
    l, a, b = C.rgb_to_lab(C.hex_to_rgb(F.col("hex")))
    p = B.palettes(spark, folder).select("palette_id", "ink", l.alias("l"), a.alias("a"), b.alias("b"))
    vl, va, vb = C.vivid((F.col("l"), F.col("a"), F.col("b")), 0.4)
    return p.select("palette_id", "ink", r6(vl, "l", 5), r6(va, "a", 4), r6(vb, "b", 4))


@query(
    "c14_saturate",
    B.ctes("flat_px")
    + f""", {S.linear_cte('t', 'flat_px')}
SELECT {KEY_SQL}, {", ".join("round(" + S.clamp01(f"{_Y} + (l{c} - {_Y}) * 1.5") + f", 6) AS {c}" for c in "rgb")} FROM t""",
)
def c14_saturate(spark, folder):
    px = with_linear(B.flat_px(spark, folder))
    r, g, b = C.saturate(lin(), 0.5)
    return px.select(*KEYS, r6(r, "r"), r6(g, "g"), r6(b, "b"))


def spectral_values() -> str:
    """VALUES rows of the seven base curves and the three response rows, one per band."""
    base, t = spectral.base_spectra(), spectral.response()
    rows = ", ".join("(" + ", ".join([str(i), *(repr(base[k][i]) + "::DOUBLE" for k in spectral.BASES), *(repr(float(t[ch][i])) + "::DOUBLE" for ch in range(3))]) + ")" for i in range(spectral.BANDS))
    return f"bands(band, bw, bc, bm, by_, br, bg, bb, tr, tg, tb) AS (VALUES {rows})"


#: Amounts of the seven bases for a table with lr, lg and lb.
WEIGHTS = """greatest(2.220446049250313e-16, least(lr, lg, lb) * bw + (least(lg, lb) - least(lr, lg, lb)) * bc + (least(lr, lb) - least(lr, lg, lb)) * bm
  + (least(lr, lg) - least(lr, lg, lb)) * by_ + greatest(0, least(lr - lb, lr - lg)) * br + greatest(0, least(lg - lb, lg - lr)) * bg + greatest(0, least(lb - lg, lb - lr)) * bb)"""


@query(
    "c15_spectrum",
    B.ctes("palettes")
    + f""", {spectral_values()}, t0 AS (SELECT palette_id, ink, {S.hex_bytes('hex')} FROM palettes), {S.linear_cte('t1', 't0')},
refl AS (SELECT palette_id, ink, band, tr, tg, tb, {WEIGHTS} AS v FROM t1, bands)
SELECT palette_id, ink, round(avg(v), 6) AS mean_reflectance, round(sum(CASE WHEN band = 17 THEN v END), 6) AS band_550,
  round(sum(v * tr), 6) AS lr, round(sum(v * tg), 6) AS lg, round(sum(v * tb), 6) AS lb FROM refl GROUP BY palette_id, ink""",
)
def c15_spectrum(spark, folder):
    lin = C.rgb_to_linear(C.hex_to_rgb(F.col("hex")))
    p = B.palettes(spark, folder).select("palette_id", "ink", spectral.linear_to_reflectance(lin).alias("s"))
    r, g, b = spectral.reflectance_to_linear(F.col("s"))
    mean = F.aggregate("s", C.num(0), lambda acc, v: acc + v) / spectral.BANDS
    return p.select("palette_id", "ink", r6(mean, "mean_reflectance"), r6(F.get("s", F.lit(17)), "band_550"), r6(r, "lr"), r6(g, "lg"), r6(b, "lb"))


_SLOTS = """slots(scheme, slot, turn, dl, lo, hi, kc) AS (VALUES ('complementary', 1, 180, 0.0, 0.0, 1.0, 1.0), ('analogous', 1, -30, 0.0, 0.0, 1.0, 1.0),
  ('analogous', 2, 30, 0.0, 0.0, 1.0, 1.0), ('triad', 1, 120, 0.0, 0.0, 1.0, 1.0), ('triad', 2, 240, 0.0, 0.0, 1.0, 1.0), ('square', 1, 90, 0.0, 0.0, 1.0, 1.0),
  ('square', 2, 180, 0.0, 0.0, 1.0, 1.0), ('square', 3, 270, 0.0, 0.0, 1.0, 1.0), ('monotone', 1, 0, 0.25, 0.0, 0.95, 0.55), ('monotone', 2, 0, -0.25, 0.12, 1.0, 0.9)),
fixed(slot, hex) AS (VALUES (0, '#3255a4'), (1, '#ff48b0'), (2, '#ffe800'), (3, '#000000'))"""
_SCHEMES = (
    B.ctes("palettes").replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", {_SLOTS}, p0 AS (SELECT palette_id, hex, {S.hex_bytes('hex')} FROM palettes WHERE ink = 0), {S.linear_cte('p1', 'p0')}, {S.oklab_cte('p2', 'p1')},
grown AS (SELECT palette_id, scheme, slot, least(hi::DOUBLE, greatest(lo::DOUBLE, ok_l + dl)) AS l, ok_c * kc AS c,
  CASE WHEN ok_h + turn >= 360 THEN ok_h + turn - 360 WHEN ok_h + turn < 0 THEN ok_h + turn + 360 ELSE ok_h + turn END AS h FROM p2, slots),
{S.fit_oklch_ctes('f', 'grown', 'palette_id, scheme, slot')},
colors AS (SELECT palette_id, scheme, slot, {S.to_hex('r', 'g', 'b')} AS hex FROM f
  UNION ALL SELECT palette_id, scheme, 0, hex FROM p0, (SELECT DISTINCT scheme FROM slots) d
  UNION ALL SELECT palette_id, 'cmyk', slot, fixed.hex FROM p0, fixed)"""
)


def _schemes(spark, folder):
    bases = B.palettes(spark, folder).where(F.col("ink") == 0).select("palette_id", "hex")
    return schemes.scheme_colors(bases, "palette_id", "hex")


@query("c16_schemes", _SCHEMES + " SELECT palette_id, scheme, CAST(slot AS INTEGER) AS slot, hex FROM colors")
def c16_schemes(spark, folder):
    return _schemes(spark, folder)


@query(
    "c16_scheme_background",
    _SCHEMES
    + f""", q0 AS (SELECT palette_id, scheme, slot, hex, {S.hex_bytes('hex')} FROM colors), {S.linear_cte('q1', 'q0')}, {S.oklab_cte('q2', 'q1')},
bg AS (SELECT *, row_number() OVER (PARTITION BY palette_id, scheme ORDER BY ok_l DESC, slot) AS rn FROM q2 WHERE slot > 0 OR scheme = 'cmyk'),
tint AS (SELECT palette_id, scheme, slot, 0.95::DOUBLE AS l, least(ok_c, 0.035) AS c, ok_h AS h FROM bg WHERE rn = 1),
{S.fit_oklch_ctes('pf', 'tint', 'palette_id, scheme, slot')},
inks AS (SELECT c.palette_id, c.scheme, string_agg(c.hex, ' ' ORDER BY c.slot) AS inks FROM colors c JOIN pf ON c.palette_id = pf.palette_id AND c.scheme = pf.scheme AND c.slot <> pf.slot GROUP BY 1, 2)
SELECT palette_id, scheme, inks, {S.to_hex('pf.r', 'pf.g', 'pf.b')} AS paper FROM inks JOIN pf USING (palette_id, scheme)""",
)
def c16_scheme_background(spark, folder):
    return schemes.with_background(_schemes(spark, folder), "palette_id")


_MUL = {c: " * ".join([repr(PAPER[i] / 255) + "::DOUBLE"] + [f"(1 + ({v[i] / 255!r}::DOUBLE - 1) * c{k})" for k, v in enumerate([(0, 0x78, 0xBF), (0xFF, 0x48, 0xB0), (0xFF, 0xE8, 0), (0, 0, 0)])]) for i, c in enumerate("rgb")}


@query(
    "c17_multiply",
    B.ctes("coverage") + f""" SELECT image_id, x, y, {", ".join(f"round({S.lin('(' + _MUL[c] + ')')}, 6) AS {c}" for c in "rgb")} FROM coverage""",
)
def c17_multiply(spark, folder):
    inks = [tuple(F.lit(v / 255) for v in rgb) for rgb in [(0, 0x78, 0xBF), (0xFF, 0x48, 0xB0), (0xFF, 0xE8, 0), (0, 0, 0)]]
    r, g, b = C.multiply_blend(tuple(F.lit(v / 255) for v in PAPER), inks, [F.col(f"c{k}") for k in range(4)])
    return B.coverage(spark, folder).select("image_id", "x", "y", r6(r, "r"), r6(g, "g"), r6(b, "b"))


@query(
    "c18_hash",
    """WITH a AS (SELECT event_id, event_id::HUGEINT % 4294967296 AS v FROM events),
b AS (SELECT event_id, v, ((v * 747796405 + 2891336453) % 4294967296)::BIGINT AS s FROM a),
c AS (SELECT event_id, v, ((xor(s >> ((s >> 28) + 4)::INTEGER, s))::HUGEINT * 277803737 % 4294967296)::BIGINT AS w FROM b),
d AS (SELECT event_id, v, xor(w >> 22, w) AS pcg FROM c),
e AS (SELECT *, ((v * 31 + 7 + 1831565813) % 4294967296)::BIGINT AS m FROM d),
f AS (SELECT *, (xor(m, m >> 15)::HUGEINT * (m | 1)::HUGEINT % 4294967296)::BIGINT AS t FROM e),
g AS (SELECT *, xor(((t::HUGEINT + (xor(t, t >> 7)::HUGEINT * (t | 61)::HUGEINT)) % 4294967296)::BIGINT, t) AS u FROM f)
SELECT event_id, pcg, round(xor(u, u >> 14) / 4294967296.0::DOUBLE, 9) AS mulberry FROM g""",
)
def c18_hash(spark, folder):
    e = read_table(spark, folder, "events").select("event_id")
    return e.select("event_id", hashing.pcg(F.col("event_id")).alias("pcg"), r6(hashing.mulberry(F.col("event_id") * 31 + 7), "mulberry", 9))


@query(
    "c19_dot_gain",
    B.ctes("coverage")
    + """, t AS (SELECT *, c0 + 4 * 0.12 * c0 * (1 - c0) AS gm, least(1, c0 * (1 + 2 * 0.168)) AS gu FROM coverage)
SELECT image_id, x, y, round(gm, 6) AS midtone, round(gu, 6) AS uniform, round((1.48 - sqrt(greatest(0, 1.48 * 1.48 - 16 * 0.12 * c1))) / (8 * 0.12), 6) AS compensated,
  round((1.48 - sqrt(greatest(0, 1.48 * 1.48 - 16 * 0.12 * gm))) / (8 * 0.12), 6) AS back, round(c1 / (1 + 2 * 0.168), 6) AS compensated_uniform FROM t""",
)
def c19_dot_gain(spark, folder):
    smooth = C.gain_amount(0.12)
    soaked = C.gain_amount(0.12, "recycled")
    c0, c1 = F.col("c0"), F.col("c1")
    return B.coverage(spark, folder).select(
        "image_id",
        "x",
        "y",
        r6(C.dot_gain(c0, smooth), "midtone"),
        r6(C.dot_gain(c0, soaked, "uniform"), "uniform"),
        r6(C.dot_gain_inverse(c1, smooth), "compensated"),
        r6(C.dot_gain_inverse(C.dot_gain(c0, smooth), smooth), "back"),
        r6(C.dot_gain_inverse(c1, soaked, "uniform"), "compensated_uniform"),
    )

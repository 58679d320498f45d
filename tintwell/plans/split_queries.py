"""Splitting, layer options and mixing over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tintwell.functions import color as C
from tintwell.functions import spectral
from tintwell.operators import layers as L
from tintwell.operators import mix as M
from tintwell.operators import spatial as SP
from tintwell.operators import split as E
from tintwell.plans import sql as S
from tintwell.plans.color_queries import KEY_SQL, KEYS, fractions, lin, spectral_values, with_linear
from tintwell.plans.curve_queries import BAND_CURVES, BANDS, R, bands
from tintwell.plans.registry import query
from tintwell.operators.curves import band_tables
from tintwell.sources import bridge as B

COV = ["c0", "c1", "c2", "c3"]


def rounded(cols, names=COV):
    return [F.round(c, 6).alias(n) for c, n in zip(cols, names)]


def image_curves(spark, folder):
    """One band setup per image; some images have paper bands only."""
    return band_tables(bands(spark, folder), ["set_id"]).withColumnRenamed("set_id", "image_id")


# ---- tone map and ink usage ----

TONE = f"""{BANDS}, {BAND_CURVES}, lut AS (SELECT set_id, i, {", ".join(f"coalesce(max(CASE WHEN ink = {k} THEN floor(v * 255 + 0.5) / 255.0::DOUBLE END), 0) AS v{k}" for k in range(4))} FROM band_curves GROUP BY set_id, i),
lut2 AS (SELECT *, {", ".join(f"coalesce(lead(v{k}) OVER w, v{k}) AS w{k}" for k in range(4))} FROM lut WINDOW w AS (PARTITION BY set_id ORDER BY i)),
spots AS (SELECT *, {S.clamp01(S.LUMA.format('(r / 255.0::DOUBLE)', '(g / 255.0::DOUBLE)', '(b / 255.0::DOUBLE)'))} * 255 AS pos FROM rgb21),
toned AS (SELECT image_id, x, y, {", ".join(f"coalesce(v{k} + (w{k} - v{k}) * (pos - floor(pos)), 0) AS c{k}" for k in range(4))} FROM spots LEFT JOIN lut2 ON set_id = image_id AND i = CAST(floor(pos) AS INTEGER))"""


@query("e1_tone_map", B.ctes("rgb21") + f", {TONE} SELECT image_id, x, y, round(c0, 6) AS c0, round(c1, 6) AS c1, round(c2, 6) AS c2, round(c3, 6) AS c3 FROM toned")
def e1_tone_map(spark, folder):
    cov = E.tone_map(B.rgb21(spark, folder), image_curves(spark, folder), ["image_id"])
    return cov.select("image_id", "x", "y", *rounded([F.col(c) for c in COV]))


_USAGE = ", ".join(f"round(avg(c{k}), 6) AS mean{k}, round(max(c{k}), 6) AS max{k}, round(avg(CASE WHEN c{k} > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS inked{k}" for k in range(4))
_UNPIVOT = " UNION ALL ".join(f"SELECT image_id, {k} AS ink, pixels, max_total, mean{k} AS mean, max{k} AS max, inked{k} AS inked FROM stats" for k in range(4))


@query(
    "ink_usage",
    B.ctes("rgb21")
    + f""", {TONE}, total AS (SELECT *, c0 + c1 + c2 + c3 AS t FROM toned),
limited AS (SELECT image_id, {", ".join(f"CASE WHEN t > 1.2 THEN c{k} * 1.2::DOUBLE / t ELSE c{k} END AS c{k}" for k in range(4))} FROM total),
stats AS (SELECT image_id, count(*) AS pixels, round(max(c0 + c1 + c2 + c3), 6) AS max_total, {_USAGE} FROM limited GROUP BY image_id)
{_UNPIVOT}""",
)
def ink_usage(spark, folder):
    """Catalogue report: tone map, total ink limit, usage per image and ink."""
    cov = E.tone_map(B.rgb21(spark, folder), image_curves(spark, folder), ["image_id"])
    limited = cov.select("image_id", *[c.alias(n) for c, n in zip(L.ink_limit([F.col(c) for c in COV], 1.2), COV)])
    usage = L.ink_usage(limited, ["image_id"])
    return usage.select("image_id", "ink", "pixels", R("max_total", "max_total"), R("mean", "mean"), R("max", "max"), R("inked", "inked"))


# ---- channels ----


def _channel_sql(space: str) -> list[str]:
    if space == "rgb":
        return ["1 - sr", "1 - sg", "1 - sb", "0", "0"]
    if space == "cmyk":
        return [f"CASE WHEN k < 0.999 THEN (1 - s{c} - k) / (1 - k) ELSE 0 END" for c in "rgb"] + ["k", "0"]
    if space == "hsl":
        return ["hue / 360", "sat", "1 - light", "0", "0"]
    if space == "lab":
        return ["1 - lab_l / 100", "greatest(lab_a, 0) / 90", "greatest(-lab_a, 0) / 90", "greatest(lab_b, 0) / 90", "greatest(-lab_b, 0) / 90"]
    return ["1 - yy", "greatest((sb - yy) / 1.772, 0) * 2", "greatest(-(sb - yy) / 1.772, 0) * 2", "greatest((sr - yy) / 1.402, 0) * 2", "greatest(-(sr - yy) / 1.402, 0) * 2"]


SPACES_CTE = f"""{S.linear_cte('s0', 'flat_px')}, {S.lab_cte('s1', 's0')}, {S.fractions_cte('s2', 's1')}, {S.hsl_cte('s3', 's2')},
spaces AS (SELECT *, least(1 - sr, 1 - sg, 1 - sb) * 0.5 AS k, 0.299 * sr + 0.587 * sg + 0.114 * sb AS yy FROM s3)"""


@query(
    "e2_channels",
    B.ctes("flat_px")
    + f", {SPACES_CTE} SELECT {KEY_SQL}, "
    + ", ".join(f"round({c}, 6) AS {space}{i}" for space in C.SPACES for i, c in enumerate(_channel_sql(space)) if c != "0")
    + " FROM spaces",
)
def e2_channels(spark, folder):
    px = E.with_spaces(with_linear(B.flat_px(spark, folder)), fractions(), lin())
    lab, hsl = tuple(F.col(c) for c in ("lab_l", "lab_a", "lab_b")), tuple(F.col(c) for c in ("hue", "sat", "light"))
    out = []
    for space in C.SPACES:
        used = sum(c != "0" for c in _channel_sql(space))
        out += [R(c, f"{space}{i}") for i, c in enumerate(E.channels(fractions(), lin(), space, lab=lab, hsl=hsl)[:used])]
    return px.select(*KEYS, *out)


ROUTES = [E.Route(0, 0, 1.3, 0.9), E.Route(1, 1), E.Route(2, 0, 0.7, 0.8), E.Route(3, 3, 2.0, 1.0)]


def _routed(k: int) -> str:
    r = ROUTES[k]
    return f"({S.clamp01(f'h{r.channel} * {r.gain}::DOUBLE')} * {r.opacity}::DOUBLE)"


_CMYK = f"""{S.fractions_cte('f0', 'flat_px')}, f1 AS (SELECT *, least(1 - sr, 1 - sg, 1 - sb) * 0.5 AS k FROM f0),
ch AS (SELECT {KEY_SQL}, {", ".join(f"{c} AS h{i}" for i, c in enumerate(_channel_sql('cmyk')))} FROM f1)"""


@query(
    "e3_route",
    B.ctes("flat_px")
    + f""", {_CMYK} SELECT {KEY_SQL}, round({S.clamp01(_routed(0) + ' + ' + _routed(2))}, 6) AS add0, round({S.clamp01(f'greatest({_routed(0)}, {_routed(2)})')}, 6) AS max0,
  round({S.clamp01(f'({_routed(0)} + {_routed(2)}) / 2')}, 6) AS average0, round({S.clamp01(f'1 - (1 - {_routed(0)}) * (1 - {_routed(2)})')}, 6) AS screen0,
  round({S.clamp01(_routed(1))}, 6) AS add1, round({S.clamp01(_routed(3))}, 6) AS add3 FROM ch""",
)
def e3_route(spark, folder):
    h = E.channels(fractions(), None, "cmyk")
    outs = {b: E.route(h, ROUTES, b) for b in ("add", "max", "average", "screen")}
    return B.flat_px(spark, folder).select(*KEYS, *[R(outs[b][0], f"{b}0") for b in outs], R(outs["add"][1], "add1"), R(outs["add"][3], "add3"))


_MATRIX = [[1.17, 0, 0.56, 0, 0, 0.05], [0, 1, -0.25, 0, 0, 0], [0, 0, 0, 0, 0, 0], [0, 0, 0, 2, 0, -0.1]]


@query(
    "e4_mix_channels",
    B.ctes("flat_px")
    + f", {_CMYK} SELECT {KEY_SQL}, "
    + ", ".join(
        "round(" + S.clamp01(" + ".join([f"{row[5]}::DOUBLE"] + [f"h{c} * ({row[c]})::DOUBLE" for c in range(5) if row[c]])) + f", 6) AS c{k}" for k, row in enumerate(_MATRIX)
    )
    + ", 1.17 AS seed00, 0.56 AS seed02 FROM ch".replace("1.17", "1.17::DOUBLE").replace("0.56", "0.56::DOUBLE"),
)
def e4_mix_channels(spark, folder):
    h = E.channels(fractions(), None, "cmyk")
    seed = E.matrix_from_routes(ROUTES)
    return B.flat_px(spark, folder).select(*KEYS, *rounded(E.mix_channels(h, _MATRIX)), F.lit(seed[0][0]).alias("seed00"), F.lit(seed[0][2]).alias("seed02"))


# ---- selective colour ----

RANGES = [
    E.ColorRange(hue=10, width=60, ink=0),
    E.ColorRange(hue=200, width=90, sat_min=0.1, feather=0.0, ink=1),
    E.ColorRange(hue=300, width=40, light_max=0.6, feather=0.5, ink=0),
]


def _smooth(lo: float, hi: float, x: str) -> str:
    t = S.clamp01(f"(({x}) - {lo!r}::DOUBLE) / {hi - lo!r}::DOUBLE")
    return f"({t} * {t} * (3 - {t} * 2))"


def _band(x: str, lo: float, hi: float, soft: float) -> str:
    if soft <= 0:
        return f"(CASE WHEN {x} >= {lo!r}::DOUBLE AND {x} <= {hi!r}::DOUBLE THEN 1.0::DOUBLE ELSE 0 END)"
    return f"({_smooth(lo - soft, lo, x)} * (1 - {_smooth(hi, hi + soft, x)}))"


def _member(r: E.ColorRange) -> str:
    turned = f"(hue - {float(r.hue)}::DOUBLE + 180)"
    away = f"abs({turned} - floor({turned} / 360) * 360 - 180)"
    near = f"(CASE WHEN {away} <= {r.width * 0.5} THEN 1.0::DOUBLE ELSE 0 END)" if r.feather <= 0 else f"(1 - {_smooth(r.width * 0.5, r.width * 0.5 + r.feather * 60, away)})"
    return f"{near} * {_band('sat', r.sat_min, r.sat_max, r.feather * 0.25)} * {_band('light', r.light_min, r.light_max, r.feather * 0.25)}"


_HSL = f"{S.fractions_cte('f0', 'flat_px')}, {S.hsl_cte('hs', 'f0')}, mem AS (SELECT *, {', '.join(f'{_member(r)} AS m{i}' for i, r in enumerate(RANGES))} FROM hs)"


@query(
    "e5_selective",
    B.ctes("flat_px")
    + f""", {_HSL} SELECT {KEY_SQL}, round({S.clamp01('greatest(m0 * sat, m2 * sat)')}, 6) AS c0, round({S.clamp01('m1 * sat')}, 6) AS c1, 0.0::DOUBLE AS c2,
  round({S.clamp01('(1 - greatest(m0, m1, m2)) * (1 - light)')}, 6) AS c3 FROM mem""",
)
def e5_selective(spark, folder):
    px = B.flat_px(spark, folder)
    h, s, l = C.hsl(fractions())
    px = px.select(*KEYS, h.alias("h"), s.alias("s"), l.alias("l"))
    return px.select(*KEYS, *rounded(E.selective((F.col("h"), F.col("s"), F.col("l")), RANGES, base=3)))


@query("e6_range_mask", B.ctes("flat_px") + f", {_HSL} SELECT {KEY_SQL}, round(m2, 6) AS mask FROM mem")
def e6_range_mask(spark, folder):
    h, s, l = C.hsl(fractions())
    px = B.flat_px(spark, folder).select(*KEYS, h.alias("h"), s.alias("s"), l.alias("l"))
    return px.select(*KEYS, R(E.membership((F.col("h"), F.col("s"), F.col("l")), RANGES[2]), "mask"))


@query(
    "e7_range_from_color",
    B.ctes("palettes")
    + f""", p0 AS (SELECT palette_id, ink, {S.hex_bytes('hex')} FROM palettes), {S.fractions_cte('p1', 'p0')}, {S.hsl_cte('p2', 'p1')}
SELECT palette_id, ink, CAST(floor(hue + 0.5) AS INTEGER) AS hue, 40 AS width, CAST(greatest(0, floor(sat * 100 - 35 + 0.5)) AS INTEGER) AS sat_min, 100 AS sat_max,
  CAST(greatest(0, floor(light * 100 - 35 + 0.5)) AS INTEGER) AS light_min, CAST(least(100, floor(light * 100 + 35 + 0.5)) AS INTEGER) AS light_max FROM p2""",
)
def e7_range_from_color(spark, folder):
    r, g, b = C.hex_to_rgb(F.col("hex"))
    p = B.palettes(spark, folder).select("palette_id", "ink", r.alias("r"), g.alias("g"), b.alias("b"))
    return p.select("palette_id", "ink", *[c.alias(n) for n, c in E.range_from_color(C.hsl(fractions())).items()])


@query(
    "e9_darkest_ink",
    B.ctes("palettes")
    + f""", p0 AS (SELECT palette_id, ink, {S.hex_bytes('hex')} FROM palettes), {S.linear_cte('p1', 'p0')}, {S.lab_cte('p2', 'p1')}
SELECT palette_id, ink FROM p2 QUALIFY row_number() OVER (PARTITION BY palette_id ORDER BY lab_l, ink) = 1""",
)
def e9_darkest_ink(spark, folder):
    return E.darkest_ink(B.palettes(spark, folder), ["palette_id"])


def _blur_sql(name: str, src: str, value: str, sigma: float, axis: str) -> str:
    """One direction of the edge-repeating blur of one column, whole-pixel taps."""
    import math

    reach = math.ceil(sigma * 2.5)
    ws = [(d, math.exp(-(d * d) / (2 * sigma * sigma))) for d in range(-reach, reach + 1)]
    total = sum(w for _, w in ws)
    terms = []
    part = "image_id, y" if axis == "x" else "image_id, x"
    win = f"(PARTITION BY {part} ORDER BY {axis})"
    full = f"(PARTITION BY {part} ORDER BY {axis} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    for d, w in ws:
        v = value if d == 0 else f"coalesce({'lag' if d < 0 else 'lead'}({value}, {abs(d)}) OVER {win}, {'first' if d < 0 else 'last'}_value({value}) OVER {full})"
        terms.append(f"{w / total!r}::DOUBLE * {v}")
    return f"{name} AS (SELECT image_id, x, y, {' + '.join(terms)} AS {value} FROM {src})"


_GRAY = "gpx AS (SELECT image_id, x, y, g / 255.0::DOUBLE AS luma FROM gray8)"
_BLUR = _blur_sql("bx", "gpx", "luma", 1.2, "x") + ", " + _blur_sql("blurred", "bx", "luma", 1.2, "y")


def _gray(spark, folder):
    return B.gray8(spark, folder).select("image_id", "x", "y", (F.col("g") / 255.0).alias("luma"))


def _edge_sql(v: str = "luma", src: str = "gpx") -> str:
    def sh(c: str, d: int, axis: str) -> str:
        part = "image_id, y" if axis == "x" else "image_id, x"
        return f"coalesce({'lag' if d < 0 else 'lead'}({c}) OVER (PARTITION BY {part} ORDER BY {axis}), {c})"

    return f"""ed AS (SELECT image_id, x, y, {v}, {sh(v, 1, 'x')} - {sh(v, -1, 'x')} AS d, {sh(v, -1, 'x')} + {v} * 2 + {sh(v, 1, 'x')} AS s FROM {src}),
edges AS (SELECT image_id, x, y, {v}, {sh('d', -1, 'y')} + d * 2 + {sh('d', 1, 'y')} AS gx, {sh('s', 1, 'y')} - {sh('s', -1, 'y')} AS gy FROM ed)"""


@query(
    "e8_detail_split",
    B.ctes("gray8")
    + f""", {_GRAY}, {_BLUR}, {_edge_sql()},
d AS (SELECT p.image_id, p.x, p.y, {S.clamp01('(b.luma - p.luma) * 1.5 * 8.0 - 0.05')} AS hp, {_smooth(0.05, 0.11, '(b.luma - p.luma) * 1.5::DOUBLE * 8.0')} AS la,
  {S.clamp01('sqrt(e.gx * e.gx + e.gy * e.gy) * 3.0 - 0.05')} AS ed, 1 - b.luma AS base0, b.luma * 0.5 AS base1
  FROM gpx p JOIN blurred b USING (image_id, x, y) JOIN edges e USING (image_id, x, y))
SELECT image_id, x, y, round(1 - (1 - base0) * (1 - hp), 6) AS highpass, round(1 - (1 - base0) * (1 - la), 5) AS lineart, round(1 - (1 - base0) * (1 - ed), 6) AS edges, round(base1, 6) AS c1 FROM d""",
)
def e8_detail_split(spark, folder):
    # Blur and gradient ride through the same two windows, so nothing is joined back.
    px = SP.sobel(SP.gaussian(_gray(spark, folder).withColumn("soft", F.col("luma")), ["soft"], 1.2), "luma", ("soft",))
    at = [F.col(c) for c in ("luma", "soft", "gx", "gy")]
    modes = [E.screened(1 - F.col("soft"), E.detail(mode, 1.5, 0.05, *at)).alias(mode) for mode in ("highpass", "lineart", "edges")]
    out = px.select("image_id", "x", "y", *modes, (F.col("soft") * 0.5).alias("c1"))
    return out.select("image_id", "x", "y", R("highpass", "highpass"), R("lineart", "lineart", 5), R("edges", "edges"), R("c1", "c1"))


# ---- layers ----


@query(
    "g1_knockout",
    B.ctes("coverage") + " SELECT image_id, x, y, round(c0 * (1 - c3) * (1 - c1 * (1 - c3)), 6) AS c0, round(c1 * (1 - c3), 6) AS c1, round(c2 * (1 - c3), 6) AS c2, round(c3, 6) AS c3 FROM coverage",
)
def g1_knockout(spark, folder):
    cov = B.coverage(spark, folder)
    return cov.select("image_id", "x", "y", *rounded(L.knockout([F.col(c) for c in COV], [False, True, False, True])))


@query(
    "g2_ink_limit",
    B.ctes("coverage")
    + ", t AS (SELECT *, c0 + c1 + c2 + c3 AS s FROM coverage) SELECT image_id, x, y, "
    + ", ".join(f"round(CASE WHEN s > 1.8 THEN c{k} * 1.8::DOUBLE / s ELSE c{k} END, 6) AS c{k}" for k in range(4))
    + " FROM t",
)
def g2_ink_limit(spark, folder):
    return B.coverage(spark, folder).select("image_id", "x", "y", *rounded(L.ink_limit([F.col(c) for c in COV], 1.8)))


TONE_TABLES = [[min(1.0, i / 255 * d) for i in range(256)] for d in (1.0, 0.8, 1.25, 0.5)]


def _trap_sql(name: str, src: str, radii: list[float], axis: str) -> str:
    import math

    part = "image_id, y" if axis == "x" else "image_id, x"
    cols = []
    for k, r in enumerate(radii):
        v, cand = f"c{k}", [f"c{k}"]
        for d in range(1, math.ceil(abs(r)) + 1):
            w = min(1.0, max(0.0, abs(r) - d + 1))
            for fn, edge in (("lag", "first"), ("lead", "last")):
                near = f"coalesce({fn}({v}, {d}) OVER (PARTITION BY {part} ORDER BY {axis}), {edge}_value({v}) OVER (PARTITION BY {part} ORDER BY {axis} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
                cand.append(f"({v} * {1 - w!r}::DOUBLE + {near} * {w!r}::DOUBLE)")
        cols.append(f"{'greatest' if r >= 0 else 'least'}({', '.join(cand)}) AS {v}" if len(cand) > 1 else v)
    return f"{name} AS (SELECT image_id, x, y, {', '.join(cols)} FROM {src})"


RADII = [1.5, -1.0, 0.0, 2.0]


@query(
    "g3_layer_chain",
    B.ctes("coverage")
    + f""", l0 AS (SELECT image_id, x, y, c0, c1 * 0.8::DOUBLE AS c1, least(1.0::DOUBLE, c2 * 1.25::DOUBLE) AS c2, c3 * 0.5::DOUBLE AS c3 FROM coverage),
l1 AS (SELECT image_id, x, y, c0 * (1 - c3) AS c0, c1 * (1 - c3) AS c1, c2 * (1 - c3) AS c2, c3 FROM l0),
{_trap_sql('l2', 'l1', RADII, 'x')}, {_trap_sql('l3', 'l2', RADII, 'y')}, l4 AS (SELECT *, c0 + c1 + c2 + c3 AS s FROM l3)
SELECT image_id, x, y, {", ".join(f"round(CASE WHEN s > 1.5 THEN c{k} * 1.5::DOUBLE / s ELSE c{k} END, 5) AS c{k}" for k in range(4))} FROM l4""",
)
def g3_layer_chain(spark, folder):
    cov = L.layer_options(B.coverage(spark, folder), TONE_TABLES, [False, False, False, True], RADII, 1.5)
    return cov.select("image_id", "x", "y", *[R(c, c, 5) for c in COV])


@query(
    "g4_visible_inks",
    B.ctes("palettes")
    + """, s AS (SELECT palette_id, ink, palette_id % 3 = 0 AND ink % 2 = 0 AS solo, (palette_id + ink) % 4 = 0 AS mute FROM palettes)
SELECT palette_id, ink FROM s QUALIFY CASE WHEN bool_or(solo) OVER (PARTITION BY palette_id) THEN solo ELSE NOT mute END""",
)
def g4_visible_inks(spark, folder):
    p, k = F.col("palette_id"), F.col("ink")
    s = B.palettes(spark, folder).select("palette_id", "ink", ((p % 3 == 0) & (k % 2 == 0)).alias("solo"), ((p + k) % 4 == 0).alias("mute"))
    return L.visible_inks(s, ["palette_id"])


# ---- overlaps and mixing ----

PAPER = "#f6f3ec"
OVERLAPS = f"""{spectral_values()}, o0 AS (SELECT palette_id, ink, opacity, {S.hex_bytes('hex')} FROM palettes), {S.linear_cte('o1', 'o0')},
papers AS (SELECT 246 AS r, 243 AS g, 236 AS b), {S.linear_cte('papers1', 'papers')}""" + """,
refl AS (SELECT palette_id, ink, opacity, band, {w} AS v, bw FROM o1, bands), paper AS (SELECT band, tr, tg, tb, {w} AS v FROM papers1, bands),
stack AS (SELECT palette_id, mask, band, tr, tg, tb, 0 AS k, v FROM (SELECT DISTINCT palette_id FROM palettes) p, (SELECT CAST(range AS INTEGER) AS mask FROM range(16)) m, paper
  UNION ALL SELECT s.palette_id, mask, s.band, tr, tg, tb, k + 1, CASE WHEN (mask >> k) & 1 = 1 THEN (1 - opacity) * s.v * least(1.0::DOUBLE, r.v / r.bw) + opacity * r.v ELSE s.v END
  FROM stack s JOIN refl r ON r.palette_id = s.palette_id AND r.ink = s.k AND r.band = s.band),
overlap AS (SELECT palette_id, mask, sum(v * tr) AS r, sum(v * tg) AS g, sum(v * tb) AS b FROM stack WHERE k = 4 GROUP BY palette_id, mask)""".format(w=__import__("tintwell.plans.color_queries", fromlist=["WEIGHTS"]).WEIGHTS)

_RECP = B.ctes("palettes").replace("WITH ", "WITH RECURSIVE ", 1)


def overlaps(spark, folder):
    return M.overlap_tables_distinct(B.palettes(spark, folder), "palette_id", F.lit(PAPER))


@query("g5_overlap_table", _RECP + f", {OVERLAPS} SELECT palette_id, mask, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM overlap")
def g5_overlap_table(spark, folder):
    return overlaps(spark, folder).select("palette_id", "mask", R("r", "r"), R("g", "g"), R("b", "b"))


def _weight(mask: int) -> str:
    return " * ".join(f"c{k}" if mask >> k & 1 else f"(1 - c{k})" for k in range(4))


_PALETTE_OF = "pc AS (SELECT *, image_id % (SELECT count(*) FROM part) AS palette_id FROM coverage)"


def paletted(spark, folder):
    """Coverage with a palette each: image_id modulo the number of palettes (keys are dense)."""
    from tintwell.session import read_table

    n = read_table(spark, folder, "part").count()
    return B.coverage(spark, folder).withColumn("palette_id", F.col("image_id") % n)


@query(
    "g6_demichel",
    _RECP.replace("palettes AS", B.SQL["cov16"] + ", " + B.SQL["coverage"] + ", palettes AS")
    + f""", {OVERLAPS}, {_PALETTE_OF},
wide AS (SELECT palette_id, {", ".join(f"max(CASE WHEN mask = {m} THEN {c} END) AS {c}{m}" for m in range(16) for c in "rgb")} FROM overlap GROUP BY palette_id)
SELECT image_id, x, y, {", ".join("round(" + " + ".join(f"{_weight(m)} * {c}{m}" for m in range(16)) + f", 5) AS {c}" for c in "rgb")} FROM pc JOIN wide USING (palette_id)""",
)
def g6_demichel(spark, folder):
    cov = paletted(spark, folder)
    # Overlaps are computed for the palettes in use only.
    used = B.palettes(spark, folder).join(cov.select("palette_id").distinct(), "palette_id", "left_semi")
    mixed = M.mix_by_palette(cov, M.overlap_tables_distinct(used, "palette_id", F.lit(PAPER)), ["palette_id"])
    return mixed.select("image_id", "x", "y", R("r", "r", 5), R("g", "g", 5), R("b", "b", 5))


@query(
    "g7_mask_color",
    _RECP.replace("palettes AS", B.SQL["cov16"] + ", " + B.SQL["coverage"] + ", palettes AS")
    + f""", {OVERLAPS}, {_PALETTE_OF}, m AS (SELECT image_id, x, y, palette_id, {" + ".join(f"CASE WHEN c{k} >= 0.5 THEN {1 << k} ELSE 0 END" for k in range(4))} AS mask FROM pc)
SELECT image_id, x, y, mask, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM m JOIN overlap USING (palette_id, mask)""",
)
def g7_mask_color(spark, folder):
    bits = [F.col(c) >= 0.5 for c in COV]
    df = paletted(spark, folder).select("image_id", "x", "y", "palette_id", M.mask_of(bits).alias("mask"))
    return M.mask_color(df, overlaps(spark, folder), ["palette_id"]).select("image_id", "x", "y", "mask", R("r", "r"), R("g", "g"), R("b", "b"))


_INK_LINS = [(0, 0.1878208, 0.5209956), (1, 0.0648033, 0.4341537), (1, 0.8069523, 0), (0, 0, 0)]


def _fixed_table() -> list[tuple[float, float, float]]:
    """A plain product table of four fixed inks, for queries that do not need palettes."""
    out = []
    for mask in range(16):
        rgb = [0.921582, 0.896269, 0.838799]
        for k, ink in enumerate(_INK_LINS):
            if mask >> k & 1:
                rgb = [v * i for v, i in zip(rgb, ink)]
        out.append(tuple(rgb))
    return out


FIXED = _fixed_table()


def _mix_sql(ch: int) -> str:
    return "(" + " + ".join(f"{_weight(m)} * {FIXED[m][ch]!r}::DOUBLE" for m in range(16)) + ")"


@query(
    "g8_supersample",
    B.ctes("coverage")
    + f""", mixed AS (SELECT image_id, x, y, {", ".join(f"{_mix_sql(i)} AS {c}" for i, c in enumerate("rgb"))} FROM coverage),
m AS (SELECT image_id, x // 2 AS px, y // 2 AS py, avg(r) AS r, avg(g) AS g, avg(b) AS b, count(*) AS n FROM mixed GROUP BY ALL)
SELECT image_id, CAST(px AS INTEGER) AS px, CAST(py AS INTEGER) AS py, {S.byte('r')} AS r, {S.byte('g')} AS g, {S.byte('b')} AS b, n,
  CAST(greatest(2, least(8, ceil((1 + image_id % 9) * 1.5 / 2.0))) AS INTEGER) AS per_axis FROM m""",
)
def g8_supersample(spark, folder):
    r, g, b = M.mix([F.col(c) for c in COV], FIXED)
    px = B.coverage(spark, folder).select(
        "image_id", F.floor(F.col("x") / 2).cast("int").alias("px"), F.floor(F.col("y") / 2).cast("int").alias("py"), r.alias("r"), g.alias("g"), b.alias("b")
    )
    out = M.supersample(px, ["image_id", "px", "py"])
    return out.withColumn("per_axis", M.samples_per_axis((F.col("image_id") % 9 + 1) / 2.0))


@query(
    "g9_unmix_paper",
    B.ctes("coverage")
    + f""", mixed AS (SELECT image_id, x, y, (1 - c0) * (1 - c1) * (1 - c2) * (1 - c3) AS bare, {", ".join(f"{_mix_sql(i)} AS {c}" for i, c in enumerate("rgb"))} FROM coverage)
SELECT image_id, x, y, {", ".join(f"round(CASE WHEN 1 - bare > 0.002 THEN {S.clamp01(f'({c} - bare * {FIXED[0][i]!r}::DOUBLE) / (1 - bare)')} ELSE 0 END, 5) AS {c}" for i, c in enumerate("rgb"))},
  round(CASE WHEN 1 - bare > 0.002 THEN 1 - bare ELSE 0 END, 6) AS alpha FROM mixed""",
)
def g9_unmix_paper(spark, folder):
    cov = [F.col(c) for c in COV]
    r, g, b, a = M.unmix_paper(M.mix(cov, FIXED), cov, tuple(F.lit(v) for v in FIXED[0]))
    return B.coverage(spark, folder).select("image_id", "x", "y", R(r, "r", 5), R(g, "g", 5), R(b, "b", 5), R(a, "alpha"))


@query(
    "g10_mask_alpha",
    B.ctes("coverage")
    + ", t AS (SELECT *, ((image_id + x + y) % 4) / 3.0::DOUBLE AS a FROM coverage) SELECT image_id, x, y, "
    + ", ".join(f"round(c{k} * a, 6) AS c{k}" for k in range(4))
    + " FROM t",
)
def g10_mask_alpha(spark, folder):
    alpha = ((F.col("image_id") + F.col("x") + F.col("y")) % 4) / 3.0
    return B.coverage(spark, folder).select("image_id", "x", "y", *rounded(L.mask_alpha([F.col(c) for c in COV], alpha)))


@query(
    "g11_ink_usage_rollup",
    B.ctes("flat_px")
    + f""", {_CMYK.replace(KEY_SQL + ', CASE', 'image_id, line, CASE', 1)}, t AS (SELECT image_id, line, {", ".join(f"{S.clamp01(f'h{k}')} AS c{k}" for k in range(4))} FROM ch),
stats AS (SELECT image_id, line, count(*) AS pixels, round(max(c0 + c1 + c2 + c3), 6) AS max_total, {_USAGE} FROM t GROUP BY ROLLUP (image_id, line))
{_UNPIVOT.replace('image_id,', 'image_id, line,')}""",
)
def g11_ink_usage_rollup(spark, folder):
    h = E.channels(fractions(), None, "cmyk")
    cov = B.flat_px(spark, folder).select("image_id", "line", *[C.clamp01(h[k]).alias(f"c{k}") for k in range(4)])
    usage = L.ink_usage(cov, ["image_id", "line"], rollup=True)
    return usage.select("image_id", "line", "ink", "pixels", *[R(c, c) for c in ("max_total", "mean", "max", "inked")])


@query(
    "g12_palette_key",
    B.ctes("palettes")
    + """, short AS (SELECT palette_id, ink, hex, opacity FROM palettes)
SELECT '#f6f3ec|' || string_agg(hex || ':' || CASE opacity WHEN 0 THEN '0.0' WHEN 0.25 THEN '0.25' ELSE '0.5' END, '|' ORDER BY ink) AS palette_key, palette_id FROM short GROUP BY palette_id""".replace(
        "SELECT '#f6f3ec|'", "SELECT palette_key, count(*) AS palettes FROM (SELECT '#f6f3ec|'"
    )
    + ") t GROUP BY palette_key",
)
def g12_palette_key(spark, folder):
    return M.palette_key(B.palettes(spark, folder), "palette_id", F.lit(PAPER)).groupBy("palette_key").agg(F.count("*").alias("palettes"))

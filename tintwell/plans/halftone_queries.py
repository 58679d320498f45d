"""Tone to dots over whole tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tintwell.functions import spots
from tintwell.operators import halftone as H
from tintwell.operators import ranks as RK
from tintwell.operators import spatial as SP
from tintwell.operators.layers import to_long
from tintwell.plans import sql as S
from tintwell.plans.curve_queries import R
from tintwell.plans.registry import query
from tintwell.plans.spatial_queries import REACH, TILES, tiles, vec_images
from tintwell.session import read_table
from tintwell.sources import bridge as B

K = ["image_id", "x", "y"]
LONG = "cov_long AS (SELECT image_id, x, y, CAST(ink AS INTEGER) AS ink, (list_value(k0, k1, k2, k3))[ink + 1] / 255.0::DOUBLE AS c, (list_value(k0, k1, k2, k3))[ink + 1] AS b FROM cov16, (SELECT range AS ink FROM range(4)) q)"
ANG = "(list_value(15.0::DOUBLE, 75.0::DOUBLE, 0.0::DOUBLE, 45.0::DOUBLE))[ink + 1]"


def inked(df):
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("ink"))


def cov_long(spark, folder):
    return to_long(B.coverage(spark, folder))


POINTS = f"pts AS (SELECT image_id, x, y, CAST(ink AS INTEGER) AS ink, 3.0::DOUBLE + ink * 0.5::DOUBLE AS size, {ANG} AS deg FROM gray8, (SELECT range AS ink FROM range(4)) q)"


def points(spark, folder):
    px = inked(B.gray8(spark, folder).select(*K))
    return px.select(*K, "ink", (F.col("ink") * 0.5 + 3.0).alias("size"), H.screen_angle("square", F.col("ink")).alias("degrees"))


_C, _N = "cos(radians(deg))", "sin(radians(deg))"
CELLS = f"""rot AS (SELECT *, ({_C} * (x + 0.5::DOUBLE) - {_N} * (y + 0.5::DOUBLE)) / size AS qx, ({_N} * (x + 0.5::DOUBLE) + {_C} * (y + 0.5::DOUBLE)) / size AS qy FROM pts),
cells AS (SELECT *, floor(qx) AS i, floor(qy) AS j, {_C} * ((floor(qx) + 0.5) * size) + {_N} * ((floor(qy) + 0.5) * size) AS sx, {_C} * ((floor(qy) + 0.5) * size) - {_N} * ((floor(qx) + 0.5) * size) AS sy, qx - floor(qx) AS u, qy - floor(qy) AS v FROM rot)"""


@query("h1_am_cell", B.ctes("gray8") + f", {POINTS}, {CELLS} SELECT image_id, x, y, ink, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(sx, 6) AS sx, round(sy, 6) AS sy, round(u, 6) AS u, round(v, 6) AS v FROM cells")
def h1_am_cell(spark, folder):
    p = points(spark, folder).withColumn("c", H.am_cell(F.col("x") + 0.5, F.col("y") + 0.5, F.col("size"), F.col("degrees")))
    return p.select(*K, "ink", "c.i", "c.j", *[R(F.col(f"c.{k}"), k) for k in ("sx", "sy", "u", "v")])


_U, _V = "((r / 127.5::DOUBLE) - 1)", "((g / 127.5::DOUBLE) - 1)"


def _cell_spot_sql(shape: str, u: str, v: str) -> str:
    return {
        "round": f"CASE WHEN abs({u}) + abs({v}) <= 1 THEN {u} * {u} + {v} * {v} ELSE 2 - ((1 - abs({u})) * (1 - abs({u})) + (1 - abs({v})) * (1 - abs({v}))) END",
        "square": f"greatest(abs({u}), abs({v}))",
        "ellipse": f"sqrt({u} * {u} + ({v} / 0.65) * ({v} / 0.65))",
        "diamond": f"abs({u}) + abs({v})",
        "line": f"abs({v})",
    }[shape]


@query(
    "h2_spot",
    B.ctes("flat_px")
    + f""" SELECT image_id, order_key, line, {", ".join(f"round({_cell_spot_sql(s, _U, _V)}, 6) AS {s}" for s in spots.SHAPES).replace("AS line", "AS line_spot")}, round({_U} * {_U} + {_V} * {_V}, 6) AS lattice_round, round({_U} * {_U} + ({_V} / 0.65) * ({_V} / 0.65), 6) AS lattice_ellipse FROM flat_px""",
)
def h2_spot(spark, folder):
    u, v = F.col("r") / 127.5 - 1, F.col("g") / 127.5 - 1
    return B.flat_px(spark, folder).select(
        "image_id", "order_key", "line", *[R(spots.cell_spot(s, u, v), "line_spot" if s == "line" else s) for s in spots.SHAPES], R(spots.lattice_spot("round", u, v), "lattice_round"), R(spots.lattice_spot("ellipse", u, v), "lattice_ellipse")
    )


def _ranks_sql(name: str, shape: str) -> str:
    u, v = "((iu + 0.5::DOUBLE) / 128 * 2 - 1)", "((iv + 0.5::DOUBLE) / 128 * 2 - 1)"
    return f"""{name} AS (SELECT iu, iv, (row_number() OVER (ORDER BY val, iu, iv) - 0.5::DOUBLE) / 16384 AS rank FROM
  (SELECT *, round({_cell_spot_sql(shape, u, v)}, 9) AS val FROM (SELECT CAST(range % 128 AS INTEGER) AS iu, CAST(range // 128 AS INTEGER) AS iv FROM range(16384)) z) y)"""


@query(
    "h3_rank_table",
    B.ctes("flat_px")
    + f""", {_ranks_sql('ra', 'round')}, {_ranks_sql('rd', 'ellipse')}
SELECT image_id, round(avg(ra.rank), 6) AS mean_round, round(avg(rd.rank), 6) AS mean_ellipse, count(*) AS n FROM flat_px JOIN ra ON ra.iu = r // 2 AND ra.iv = g // 2 JOIN rd ON rd.iu = r // 2 AND rd.iv = g // 2 GROUP BY image_id""",
)
def h3_rank_table(spark, folder):
    px = B.flat_px(spark, folder)
    u, v = F.floor(F.col("r") / 2) / 128.0, F.floor(F.col("g") / 2) / 128.0
    a = H.rank_at(px, H.rank_table(spark, "round"), u, v).withColumnRenamed("rank", "rank_a")
    b = H.rank_at(a, H.rank_table(spark, "ellipse"), u, v).withColumnRenamed("rank", "rank_b")
    return b.groupBy("image_id").agg(R(F.avg("rank_a"), "mean_round"), R(F.avg("rank_b"), "mean_ellipse"), F.count("*").alias("n"))


_SHARE = "least(1, 0.7853981633974483::DOUBLE * 1.2::DOUBLE * 1.2::DOUBLE / (size * size))"


@query(
    "h4_am_halftone",
    B.ctes("gray8", "cov16")
    + f""", {LONG}, {POINTS}, {CELLS}, {_ranks_sql('rk', 'round')},
red AS (SELECT c.*, l.c * 0.9::DOUBLE AS c0 FROM cells c JOIN cov_long l ON l.image_id = c.image_id AND l.ink = c.ink AND l.x = least(3, greatest(0, floor(sx / 2))) AND l.y = least(3, greatest(0, floor(sy / 2)))),
ton AS (SELECT *, CASE WHEN c0 < {_SHARE} THEN CASE WHEN c0 > 0.02 THEN {_SHARE} ELSE 0 END ELSE c0 END AS t FROM red)
SELECT image_id, x, y, ink, CASE WHEN t <= 0 THEN false WHEN t >= 0.999 THEN true ELSE rank < t END AS "on" FROM ton JOIN rk ON iu = least(127, CAST(floor(u * 128) AS INTEGER)) AND iv = least(127, CAST(floor(v * 128) AS INTEGER))""",
)
def h4_am_halftone(spark, folder):
    ranks = H.rank_table(spark, "round")
    return H.am_halftone(points(spark, folder), cov_long(spark, folder), ranks, 2.0, 4, 4, None, 0.9, 1.2, "round")


@query(
    "h5_min_dot",
    B.ctes("cov16")
    + f""", {LONG}, t AS (SELECT *, least(1, 0.7853981633974483::DOUBLE * 2.25::DOUBLE / 16) AS s FROM cov_long)
SELECT image_id, x, y, ink, round(CASE WHEN c < s THEN 0 ELSE c END, 6) AS dropped, round(CASE WHEN c < s THEN CASE WHEN c > 0.02 THEN s ELSE 0 END ELSE c END, 6) AS rounded FROM t""",
)
def h5_min_dot(spark, folder):
    c = F.col("c")
    return cov_long(spark, folder).select(*K, "ink", R(spots.min_dot(c, 1.5, 4.0), "dropped"), R(spots.min_dot(c, 1.5, 4.0, "round"), "rounded"))


_HX, _HR = repr(H.HEX_STEP) + "::DOUBLE", repr(H.HEX_ROW) + "::DOUBLE"
PX_POINTS = "hp AS (SELECT image_id, order_key, line, r / 16.0::DOUBLE - 7 AS x, g / 20.0::DOUBLE - 5 + b / 1000.0::DOUBLE AS y FROM flat_px)"


def px_points(spark, folder):
    return B.flat_px(spark, folder).select("image_id", "order_key", "line", (F.col("r") / 16.0 - 7).alias("x"), (F.col("g") / 20.0 - 5 + F.col("b") / 1000.0).alias("y"))


@query(
    "h6_nearest_hex",
    B.ctes("flat_px")
    + f""", {PX_POINTS}, hq AS (SELECT *, floor((x - y / {_HR} * {_HX} * 0.5) / {_HX}) AS i0, floor(y / {_HR}) AS j0 FROM hp),
hc AS (SELECT *, (i0 + di) * {_HX} + (j0 + dj) * ({_HX} * 0.5) AS cx, (j0 + dj) * {_HR} AS cy FROM hq, (VALUES (0), (1)) a(di), (VALUES (0), (1)) b(dj)),
hd AS (SELECT image_id, order_key, line, x, y, min(pow(x - cx, 2) + pow(y - cy, 2)) AS d FROM hc GROUP BY image_id, order_key, line, x, y)
SELECT image_id, count(*) AS n, round(avg(sqrt(d)), 6) AS mean_d, round(max(d), 6) AS max_d FROM hd GROUP BY image_id""",
)
def h6_nearest_hex(spark, folder):
    p = px_points(spark, folder).distinct().select("image_id", H.nearest_hex(F.col("x"), F.col("y")).alias("c"))
    return p.groupBy("image_id").agg(F.count("*").alias("n"), R(F.avg(F.sqrt("c.d")), "mean_d"), R(F.max("c.d"), "max_d"))


@query(
    "h7_nearest_ring",
    B.ctes("flat_px")
    + f""", {PX_POINTS}, rq AS (SELECT *, floor(sqrt(x * x + y * y) + 0.5) AS k0, atan2(y, x) AS t FROM (SELECT DISTINCT * FROM hp) z),
rc AS (SELECT *, greatest(0, k0 + dk) AS k, CASE WHEN greatest(0, k0 + dk) < 0.5 THEN 1 ELSE greatest(1, floor(greatest(0, k0 + dk) * {H.TAU / 1.3!r}::DOUBLE + 0.5)) END AS cnt FROM rq, (VALUES (-1), (0), (1)) a(dk)),
rd AS (SELECT image_id, order_key, line, x, y, min(pow(x - k * cos((floor(t / {H.TAU!r}::DOUBLE * cnt + 0.5) + dj) * {H.TAU!r}::DOUBLE / cnt), 2) + pow(y - k * sin((floor(t / {H.TAU!r}::DOUBLE * cnt + 0.5) + dj) * {H.TAU!r}::DOUBLE / cnt), 2)) AS d,
  any_value(abs(sqrt(x * x + y * y) - k0) < 0.15) AS line_on FROM rc, (VALUES (-1), (0), (1)) b(dj) GROUP BY image_id, order_key, line, x, y)
SELECT image_id, count(*) AS n, round(avg(sqrt(d)), 6) AS mean_d, round(max(d), 6) AS max_d, CAST(sum(CASE WHEN line_on THEN 1 ELSE 0 END) AS BIGINT) AS on_line FROM rd GROUP BY image_id""",
)
def h7_nearest_ring(spark, folder):
    x, y = F.col("x"), F.col("y")
    p = px_points(spark, folder).distinct().select("image_id", H.nearest_ring(x, y, 1.3).alias("c"), H.ring_line(x, y, F.lit(0.3)).alias("l"))
    return p.groupBy("image_id").agg(F.count("*").alias("n"), R(F.avg(F.sqrt("c.d")), "mean_d"), R(F.max("c.d"), "max_d"), F.sum(F.col("l").cast("bigint")).alias("on_line"))


_STEP = repr(math.radians(H.GOLDEN_ANGLE)) + "::DOUBLE"
SITES = f"sites AS (SELECT event_id AS site, sqrt(event_id / pi()) * cos(event_id * {_STEP}) AS sx, sqrt(event_id / pi()) * sin(event_id * {_STEP}) AS sy FROM events)"


def sites(spark, folder):
    e = read_table(spark, folder, "events").select(F.col("event_id").alias("site"))
    x, y = H.spiral_point(F.col("site"), 137.5)
    return e.select("site", x.alias("sx"), y.alias("sy"))


_FAR = "greatest(" + ", ".join(f"sqrt(pow({a}, 2) + pow({b}, 2))" for a in ("width * 0.4::DOUBLE", "(width - width * 0.4::DOUBLE)") for b in ("height * 0.7::DOUBLE", "(height - height * 0.7::DOUBLE)")) + ")"


@query(
    "h8_spiral_points",
    B.ctes("images") + f""", {SITES} SELECT site AS id, 'point' AS kind, round(sx, 5) AS x, round(sy, 5) AS y, CAST(NULL AS BIGINT) AS points FROM sites
UNION ALL SELECT image_id, 'count', NULL, NULL, CAST(pow(2, ceil(log2(pi() * pow({_FAR} / 8 + 3, 2)))) AS BIGINT) FROM images""",
)
def h8_spiral_points(spark, folder):
    p = sites(spark, folder).select(F.col("site").alias("id"), F.lit("point").alias("kind"), R("sx", "x", 5), R("sy", "y", 5), F.lit(None).cast("bigint").alias("points"))
    n = H.spiral_count(F.col("width"), F.col("height"), F.lit(0.4), F.lit(0.7), F.lit(8.0))
    null = F.lit(None).cast("double")
    counts = B.images(spark, folder).select(F.col("image_id").alias("id"), F.lit("count").alias("kind"), null.alias("x"), null.alias("y"), n.alias("points"))
    return p.unionByName(counts)


@query(
    "h9_nearest_bucketed",
    f"""WITH {SITES}, qs AS (SELECT DISTINCT (l_partkey * 37 % 1999) / 100.0::DOUBLE - 10 AS x, (l_suppkey * 53 + l_orderkey * 7) % 1801 / 100.0::DOUBLE - 9 AS y FROM lineitem),
nb AS (SELECT x, y, site, pow(x - sx, 2) + pow(y - sy, 2) AS d FROM qs, (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j) JOIN sites ON floor(sx) = floor(x) + i AND floor(sy) = floor(y) + j)
SELECT x, y, arg_min(site, d) AS site, round(min(d), 6) AS d FROM nb GROUP BY x, y""",
)
def h9_nearest_bucketed(spark, folder):
    l = read_table(spark, folder, "lineitem")
    x = (F.col("l_partkey") * 37 % 1999) / 100.0 - 10
    y = (F.col("l_suppkey") * 53 + F.col("l_orderkey") * 7) % 1801 / 100.0 - 9
    qs = l.select(x.alias("x"), y.alias("y")).distinct().withColumns({"kx": F.col("x"), "ky": F.col("y")})
    near = H.nearest_site(qs, sites(spark, folder), ["kx", "ky"])
    return near.select(F.col("kx").alias("x"), F.col("ky").alias("y"), "site", R("d", "d"))


NUDGE = "field AS (SELECT a.image_id, a.x AS tx, a.y AS ty, a.g / 255.0::DOUBLE - 0.5 AS nx, b.g / 255.0::DOUBLE - 0.5 AS ny FROM gray8 a JOIN gray8 b ON a.image_id = b.image_id AND a.x = b.y AND a.y = b.x)"


def nudges(spark, folder):
    g = B.gray8(spark, folder)
    a = g.select("image_id", F.col("x").alias("tx"), F.col("y").alias("ty"), (F.col("g") / 255.0 - 0.5).alias("nx"))
    b = g.select("image_id", F.col("y").alias("tx"), F.col("x").alias("ty"), (F.col("g") / 255.0 - 0.5).alias("ny"))
    return a.join(b, ["image_id", "tx", "ty"])


@query(
    "h10_nearest_jittered",
    B.ctes("gray8")
    + f""", {NUDGE}, np AS (SELECT image_id, p, x + g / 256.0::DOUBLE AS x, y + (g * 7 % 256) / 256.0::DOUBLE AS y FROM gray8),
nc AS (SELECT np.image_id, p, x, y, floor(x) + i + 0.5 + nx * 0.8::DOUBLE AS px, floor(y) + j + 0.5 + ny * 0.8::DOUBLE AS py FROM np, (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j)
  JOIN field f ON f.image_id = np.image_id AND f.tx = (CAST(floor(x) AS INTEGER) + i + 8) % 8 AND f.ty = (CAST(floor(y) AS INTEGER) + j + 8) % 8)
SELECT image_id, p, round(min(pow(x - px, 2) + pow(y - py, 2)), 6) AS d FROM nc GROUP BY image_id, p""",
)
def h10_nearest_jittered(spark, folder):
    g = B.gray8(spark, folder)
    pts = g.select("image_id", "p", (F.col("x") + F.col("g") / 256.0).alias("x"), (F.col("y") + (F.col("g") * 7 % 256) / 256.0).alias("y"))
    return H.nearest_jittered(pts, nudges(spark, folder), ["image_id"], ["image_id", "p"], 8, 0.8).select("image_id", "p", R("d", "d"))


def _quantile_sql(src: str, key: str, value: str, q: str) -> str:
    """i and v of 256 interpolated order statistics of a value per key."""
    return f"""srt AS (SELECT {key}, {value} AS v, row_number() OVER (PARTITION BY {key} ORDER BY {value}) - 1 AS rn, count(*) OVER (PARTITION BY {key}) AS n FROM {src}),
ask AS (SELECT {key}, CAST(range AS INTEGER) AS i, {q} * (n - 1) AS pos, n FROM (SELECT DISTINCT {key}, n FROM srt) z, range(256)),
tab AS (SELECT a.{key}, a.i, lo.v + (hi.v - lo.v) * (pos - floor(pos)) AS v FROM ask a JOIN srt lo ON lo.{key} = a.{key} AND lo.rn = floor(pos) JOIN srt hi ON hi.{key} = a.{key} AND hi.rn = least(a.n - 1, floor(pos) + 1))"""


@query("h11_threshold_table", f"WITH {_quantile_sql('events', 'event_type', 'value', 'range / 255.0::DOUBLE')} SELECT event_type, i, round(CASE WHEN i = 0 THEN -1 ELSE v END, 6) AS v FROM tab")
def h11_threshold_table(spark, folder):
    e = read_table(spark, folder, "events").select("event_type", "value")
    return H.lattice_tables(e, ["event_type"], "value").select("event_type", "i", R("v", "v"))


@query(
    "h12_lattice_halftone",
    B.ctes("flat_px")
    + f""", {PX_POINTS}, dp AS (SELECT DISTINCT image_id, x, y FROM hp), lq AS (SELECT *, floor((x - y / {_HR} * {_HX} * 0.5) / {_HX}) AS i0, floor(y / {_HR}) AS j0 FROM dp),
lc AS (SELECT *, (i0 + di) * {_HX} + (j0 + dj) * ({_HX} * 0.5) AS cx, (j0 + dj) * {_HR} AS cy FROM lq, (VALUES (0), (1)) a(di), (VALUES (0), (1)) b(dj)),
spot AS (SELECT image_id, x, y, min(pow(x - cx, 2) + pow(y - cy, 2)) AS spot, 1 AS one FROM lc GROUP BY image_id, x, y),
{_quantile_sql('spot', 'one', 'spot', 'range / 255.0::DOUBLE')}, tb AS (SELECT i, CASE WHEN i = 0 THEN -1 ELSE v END AS v FROM tab),
tn AS (SELECT *, (image_id % 17) / 16.0::DOUBLE AS tone, (image_id % 17) / 16.0::DOUBLE * 255 AS pos FROM spot)
SELECT image_id, count(*) AS n, CAST(sum(CASE WHEN tone <= 0 THEN 0 WHEN tone >= 0.999 THEN 1 WHEN spot < a.v + (coalesce(b.v, a.v) - a.v) * (pos - floor(pos)) THEN 1 ELSE 0 END) AS BIGINT) AS inked
FROM tn JOIN tb a ON a.i = floor(pos) LEFT JOIN tb b ON b.i = floor(pos) + 1 GROUP BY image_id""",
)
def h12_lattice_halftone(spark, folder):

    p = px_points(spark, folder).select("image_id", "x", "y").distinct()
    p = p.select("image_id", H.nearest_hex(F.col("x"), F.col("y"))["d"].alias("spot"), ((F.col("image_id") % 17) / 16.0).alias("tone"), F.lit(1).alias("one"))
    table = H.lattice_tables(p, ["one"], "spot")
    dots = H.threshold_test(p, table, ["one"], "tone", "spot")
    return dots.groupBy("image_id").agg(F.count("*").alias("n"), F.sum(F.col("on").cast("bigint")).alias("inked"))


OFFSETS = [(0, 0), (3, 5), (6, 1), (2, 7)]
_OX = "(list_value(0, 3, 6, 2))[ink + 1]"
_OY = "(list_value(0, 5, 1, 7))[ink + 1]"
DITHER = f"""{LONG}, {TILES}, dith AS (SELECT l.image_id, x, y, ink, c, b, c > 0.004 AND threshold < 0.05::DOUBLE + c * (0.95::DOUBLE - 0.05::DOUBLE) AS lit FROM cov_long l JOIN tiles t ON t.image_id = l.image_id AND tx = (x + {_OX}) % 8 AND ty = (y + {_OY}) % 8)"""


@query("h13_ordered_dither", B.ctes("gray8", "cov16") + f', {DITHER} SELECT image_id, x, y, ink, lit AS "on" FROM dith')
def h13_ordered_dither(spark, folder):
    out = H.ordered_dither(cov_long(spark, folder), tiles(spark, folder), ["image_id"], 8, 0.05, 0.95, OFFSETS)
    return out.select(*K, "ink", "on")


@query(
    "h14_round_dots",
    B.ctes("gray8", "cov16")
    + f""", {DITHER}, sub AS (SELECT d.image_id, ink, d.x * 2 + a.range - 2 AS x, d.y * 2 + b.range - 2 AS y FROM dith d, range(6) a, range(6) b WHERE lit AND pow((a.range - 2 + 0.5) / 2 - 0.5, 2) + pow((b.range - 2 + 0.5) / 2 - 0.5, 2) <= 0.5)
SELECT DISTINCT image_id, ink, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM sub""",
)
def h14_round_dots(spark, folder):
    cells = H.ordered_dither(cov_long(spark, folder), tiles(spark, folder), ["image_id"], 8, 0.05, 0.95, OFFSETS)
    return H.round_dots(cells, 2, 0.5)


@query(
    "h15_dot_coverage",
    B.ctes("gray8") + f", {REACH} SELECT image_id, CAST(s.range AS INTEGER) AS i, round(count(*) FILTER (WHERE reach < s.range / 64.0::DOUBLE) / count(*)::DOUBLE, 6) AS v FROM reach, range(65) s GROUP BY image_id, s.range",
)
def h15_dot_coverage(spark, folder):
    reach = SP.disc_reach(tiles(spark, folder), ["image_id"], 8)
    return H.dot_coverage(reach, ["image_id"], 64).select("image_id", "i", R("v", "v"))


@query("h16_equalize", "SELECT event_id, event_type, round((rank() OVER (PARTITION BY event_type ORDER BY value) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY event_type) - 0.5, 6) AS r FROM events")
def h16_equalize(spark, folder):
    e = read_table(spark, folder, "events").select("event_id", "event_type", "value")
    return RK.equalize(e, ["event_type"], "value", "r").select("event_id", "event_type", R("r", "r"))


def _pcg_sql(name: str, src: str, value: str, out: str, keep: str) -> str:
    return f"""{name}_s AS (SELECT {keep}, ((({value})::HUGEINT % 4294967296 * 747796405 + 2891336453) % 4294967296)::BIGINT AS s FROM {src}),
{name}_w AS (SELECT {keep}, ((xor(s >> ((s >> 28) + 4)::INTEGER, s))::HUGEINT * 277803737 % 4294967296)::BIGINT AS w FROM {name}_s),
{name} AS (SELECT {keep}, xor(w >> 22, w) AS {out} FROM {name}_w)"""


def _white_sql(name: str, size: int, stream: int) -> str:
    return f"""{_pcg_sql(name + '_h', 'seeds', f'sid * 977 + 13 + {stream * 7919}', 'h', 'sid')}, {name}_c AS (SELECT sid, h, CAST(range % {size} AS INTEGER) AS tx, CAST(range // {size} AS INTEGER) AS ty, range AS cell FROM {name}_h, range({size * size})),
{_pcg_sql(name + '_d', name + '_c', 'h + cell', 'd', 'sid, tx, ty')}, {name} AS (SELECT sid, tx, ty, (d >> 8) / 16777216.0::DOUBLE - 0.5 AS v FROM {name}_d)"""


def _wrapv(name: str, src: str, axis: str, sigma: float, size: int) -> str:
    r = math.ceil(sigma * 3)
    ws = [(d, math.exp(-(d * d) / (2 * sigma * sigma))) for d in range(-r, r + 1)]
    total = sum(w for _, w in ws)
    other = "ty" if axis == "tx" else "tx"
    vals = ", ".join(f"({d}, {w / total!r}::DOUBLE)" for d, w in ws)
    return f"{name} AS (SELECT sid, {other}, ({axis} + d + {size * 8}) % {size} AS {axis}, sum(v * w) AS v FROM {src}, (VALUES {vals}) k(d, w) GROUP BY 1, 2, 3)"


SEEDS = "seeds AS (SELECT s_suppkey AS sid FROM supplier)"


def seeds(spark, folder):
    return read_table(spark, folder, "supplier").select(F.col("s_suppkey").alias("sid"))


def _blue_sql(name: str, stream: int) -> str:
    return f"""{_white_sql(name + '_n', 16, stream)}, {_wrapv(name + '_x', name + '_n', 'tx', 1.0, 16)}, {_wrapv(name + '_y', name + '_x', 'ty', 1.0, 16)},
{name} AS (SELECT sid, tx, ty, rank() OVER (PARTITION BY sid ORDER BY n.v - b.v) AS rk FROM {name}_n n JOIN {name}_y b USING (sid, tx, ty))"""


@query(
    "h17_noise_blue",
    f"WITH {SEEDS}, {_blue_sql('bx', 0)}, {_blue_sql('by_', 1)} SELECT sid, tx, ty, round((bx.rk - 0.5::DOUBLE) / 256 - 0.5, 6) AS nx, round((by_.rk - 0.5::DOUBLE) / 256 - 0.5, 6) AS ny FROM bx JOIN by_ USING (sid, tx, ty)",
)
def h17_noise_blue(spark, folder):
    return H.noise_field(seeds(spark, folder), "sid", "blue", 16).select("sid", "tx", "ty", R("nx", "nx"), R("ny", "ny"))


def _octave_sql(name: str, k: int, scale: int, size: int) -> str:
    g = size // scale
    fade = lambda d: f"((1 - abs({d}) / {scale}.0::DOUBLE) * (1 - abs({d}) / {scale}.0::DOUBLE) * (3 - (1 - abs({d}) / {scale}.0::DOUBLE) * 2))"
    return f"""{_white_sql(name + '_g', g, k + 1)}, {name}_r AS (SELECT sid, (tx * {scale} + a.d + {size * 4}) % {size} AS tx, (ty * {scale} + b.d + {size * 4}) % {size} AS ty, sum(v * {fade('a.d')} * {fade('b.d')}) AS v
  FROM {name}_g, (SELECT CAST(range - {scale - 1} AS INTEGER) AS d FROM range({2 * scale - 1})) a, (SELECT CAST(range - {scale - 1} AS INTEGER) AS d FROM range({2 * scale - 1})) b GROUP BY 1, 2, 3),
{name} AS (SELECT sid, tx, ty, v / sqrt(avg(v * v) OVER (PARTITION BY sid)) AS v FROM {name}_r)"""


@query(
    "h17_noise_pink",
    f"WITH {SEEDS}, {', '.join(_octave_sql(f'o{k}', k, 2 << k, 16) for k in range(4))}, al AS (SELECT * FROM o0 UNION ALL SELECT * FROM o1 UNION ALL SELECT * FROM o2 UNION ALL SELECT * FROM o3) SELECT sid, CAST(tx AS INTEGER) AS tx, CAST(ty AS INTEGER) AS ty, round(sum(v), 6) AS v FROM al GROUP BY 1, 2, 3",
)
def h17_noise_pink(spark, folder):
    return H.pink_field(seeds(spark, folder), "sid", 16).select("sid", "tx", "ty", R("v", "v"))


@query(
    "h17_noise_green",
    f"""WITH {SEEDS}, {_white_sql('g0', 16, 0)}, {_wrapv('gx_', 'g0', 'tx', 1.6, 16)}, {_wrapv('gy_', 'gx_', 'ty', 1.6, 16)}, {_white_sql('j1', 16, 1)}, {_white_sql('j2', 16, 2)},
sl AS (SELECT c.sid, c.tx, c.ty, e.v - w.v AS gx, s.v - n.v AS gy FROM gy_ c JOIN gy_ e ON e.sid = c.sid AND e.ty = c.ty AND e.tx = (c.tx + 1) % 16 JOIN gy_ w ON w.sid = c.sid AND w.ty = c.ty AND w.tx = (c.tx + 15) % 16
  JOIN gy_ s ON s.sid = c.sid AND s.tx = c.tx AND s.ty = (c.ty + 1) % 16 JOIN gy_ n ON n.sid = c.sid AND n.tx = c.tx AND n.ty = (c.ty + 15) % 16),
sc AS (SELECT *, 0.7 / sqrt(avg(gx * gx + gy * gy) OVER (PARTITION BY sid)) AS k FROM sl),
mv AS (SELECT sid, tx, ty, gx * k + j1.v * 0.15 AS dx, gy * k + j2.v * 0.15 AS dy FROM sc JOIN j1 USING (sid, tx, ty) JOIN j2 USING (sid, tx, ty))
SELECT sid, CAST(tx AS INTEGER) AS tx, CAST(ty AS INTEGER) AS ty, round(CASE WHEN sqrt(dx * dx + dy * dy) > 0.5 THEN dx * 0.5 / sqrt(dx * dx + dy * dy) ELSE dx END, 6) AS nx, round(CASE WHEN sqrt(dx * dx + dy * dy) > 0.5 THEN dy * 0.5 / sqrt(dx * dx + dy * dy) ELSE dy END, 6) AS ny FROM mv""",
)
def h17_noise_green(spark, folder):
    return H.noise_field(seeds(spark, folder), "sid", "green", 16, 4.0).select("sid", "tx", "ty", R("nx", "nx"), R("ny", "ny"))


_CARRY = "sum(g) OVER (PARTITION BY image_id, y ORDER BY {o} ROWS UNBOUNDED PRECEDING)"


@query("h18_carry_round", B.ctes("gray8") + f', t AS (SELECT *, {_CARRY.format(o="x")} AS s FROM gray8) SELECT image_id, x, y, CAST((2 * s + 255) // 510 - (2 * (s - g) + 255) // 510 AS INTEGER) AS "on" FROM t')
def h18_carry_round(spark, folder):
    return H.carry_round(B.gray8(spark, folder), ["image_id", "y"], F.col("x"), "g").select(*K, "on")


@query(
    "h19_serpentine",
    B.ctes("gray8") + f', t AS (SELECT *, {_CARRY.format(o="CASE WHEN y % 2 = 1 THEN -x ELSE x END")} AS s FROM gray8) SELECT image_id, x, y, CAST((2 * s + 255) // 510 - (2 * (s - g) + 255) // 510 AS INTEGER) AS "on" FROM t',
)
def h19_serpentine(spark, folder):
    return H.carry_round(B.gray8(spark, folder), ["image_id", "y"], H.serpentine(F.col("x"), F.col("y")), "g").select(*K, "on")


@query(
    "h20_threshold_jitter",
    B.ctes("gray8", "cov16")
    + f""", {LONG}, {TILES}, jt AS (SELECT l.image_id, x, y, ink, c, threshold FROM cov_long l JOIN tiles t ON t.image_id = l.image_id AND tx = x AND ty = y),
{_pcg_sql('ja', 'jt', 'x * 73856093 + y * 19349663 + ink * 83492791 + 7', 'ka', 'image_id, x, y, ink, c, threshold')}, {_pcg_sql('jb', 'ja', 'ka', 'kb', 'image_id, x, y, ink, c, threshold')}
SELECT image_id, x, y, ink, c > 0.004 AND threshold + ((kb >> 8) / 16777216.0::DOUBLE - 0.5) * 0.3 < c AS "on" FROM jb""",
)
def h20_threshold_jitter(spark, folder):
    out = H.ordered_dither(cov_long(spark, folder), tiles(spark, folder), ["image_id"], 8, 0.0, 1.0, None, 0.3, 7)
    return out.select(*K, "ink", "on")


TONES = [(j / 32) ** 1.5 * 1.1 for j in range(33)]
SEL = "ps AS (SELECT image_id, p AS i, x + g / 256.0::DOUBLE AS x, y + (g * 3 % 256) / 256.0::DOUBLE AS y, CAST(least(65534, (p * 65535) // 64) AS INTEGER) AS rank16 FROM gray8)"


def stipple_points(spark, folder):
    g = B.gray8(spark, folder)
    return g.select("image_id", F.col("p").alias("i"), (F.col("x") + F.col("g") / 256.0).alias("x"), (F.col("y") + (F.col("g") * 3 % 256) / 256.0).alias("y"))


@query(
    "h21_ranked_select",
    B.ctes("gray8")
    + f""", {SEL}, tt(j, t) AS (VALUES {", ".join(f"({j}, {t!r}::DOUBLE)" for j, t in enumerate(TONES))}), pf AS MATERIALIZED (SELECT *, CAST(floor(x) AS INTEGER) AS fx, CAST(floor(y) AS INTEGER) AS fy FROM ps),
pc AS MATERIALIZED (SELECT pf.*, s.g / 255.0::DOUBLE AS c FROM pf JOIN gray8 s ON s.image_id = pf.image_id AND s.x = fx AND s.y = fy),
tw AS (SELECT *, coalesce(lead(t) OVER (ORDER BY j), t) AS w FROM tt),
pt AS (SELECT pc.*, t + (w - t) * (c * 32 - floor(c * 32)) AS lim FROM pc JOIN tw ON j = CAST(floor(c * 32) AS INTEGER))
SELECT image_id, i FROM pt WHERE c > 0.002 AND rank16 / 65535.0::DOUBLE < lim""",
)
def h21_ranked_select(spark, folder):
    p = stipple_points(spark, folder).withColumn("rank16", F.least(F.lit(65534), F.floor(F.col("i") * 65535 / 64).cast("int")))
    cov = B.gray8(spark, folder).select(*K, (F.col("g") / 255.0).alias("c"))
    return H.ranked_select(p, cov, TONES).select("image_id", "i")


@query(
    "h22_bucket_points",
    B.ctes("gray8")
    + f""", {SEL}, {_pcg_sql('ha', 'ps', 'xor(i::BIGINT, 1540483477)', 'h', 'image_id, i, x, y, rank16')}, {_pcg_sql('hb', 'ha', 'h', 'u0', 'image_id, i, x, y, rank16, h')}, {_pcg_sql('hc', 'hb', 'h + 2654435769', 'u1', 'image_id, i, x, y, rank16, u0')},
mv AS (SELECT image_id, i, rank16, x + sqrt((u1 >> 8) / 16777216.0::DOUBLE) * 0.35 * cos((u0 >> 8) / 16777216.0::DOUBLE * 2 * pi()) AS mx, y + sqrt((u1 >> 8) / 16777216.0::DOUBLE) * 0.35 * sin((u0 >> 8) / 16777216.0::DOUBLE * 2 * pi()) AS my FROM hc),
wr AS (SELECT image_id, i, rank16, mx - floor(mx / 8) * 8 AS x, my - floor(my / 8) * 8 AS y FROM mv), bk AS (SELECT *, CAST(least(7, floor(x)) AS INTEGER) AS bx, CAST(least(7, floor(y)) AS INTEGER) AS by_ FROM wr)
SELECT image_id, i, bx, by_ AS by, CAST(row_number() OVER (PARTITION BY image_id, bx, by_ ORDER BY i) - 1 AS INTEGER) AS slot, row_number() OVER (PARTITION BY image_id, bx, by_ ORDER BY i) <= 2 AS fits, rank16 FROM bk""",
)
def h22_bucket_points(spark, folder):
    moved = H.jitter_points(stipple_points(spark, folder), 8, 0.5)
    return H.bucket_points(moved, ["image_id"], 8, 2).select("image_id", "i", "bx", "by", "slot", "fits", "rank16")


@query("h23_area_thresholds", B.ctes("gray8") + f", {_quantile_sql('gray8', 'label', 'g', '(1 - range / 255.0::DOUBLE)')} SELECT label, i, round(CASE i WHEN 0 THEN 1e9 WHEN 255 THEN -1e9 ELSE v END, 6) AS v FROM tab")
def h23_area_thresholds(spark, folder):
    return H.area_tables(B.gray8(spark, folder), ["label"], "g").select("label", "i", R("v", "v"))


@query(
    "h24_field_halftone",
    B.ctes("gray8")
    + f""", fp AS (SELECT image_id, p, label, x * 1.37::DOUBLE + 0.21 AS x, y * 0.83::DOUBLE - 0.4 AS y, (255 - g) / 255.0::DOUBLE AS tone FROM gray8),
fc AS (SELECT fp.*, (CAST(floor(fp.x - 0.5) AS INTEGER) + i + 16) % 8 AS tx, (CAST(floor(fp.y - 0.5) AS INTEGER) + j + 16) % 8 AS ty, (CASE WHEN i = 1 THEN fp.x - 0.5 - floor(fp.x - 0.5) ELSE 1 - (fp.x - 0.5 - floor(fp.x - 0.5)) END)
  * (CASE WHEN j = 1 THEN fp.y - 0.5 - floor(fp.y - 0.5) ELSE 1 - (fp.y - 0.5 - floor(fp.y - 0.5)) END) AS w FROM fp, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)),
ff AS (SELECT fc.image_id, fc.p, fc.label, fc.tone, round(sum(s.g * w), 6) AS f FROM fc JOIN gray8 s ON s.image_id = fc.image_id AND s.x = tx AND s.y = ty GROUP BY ALL),
{_quantile_sql('gray8', 'label', 'g', '(1 - range / 255.0::DOUBLE)')}, tb AS (SELECT label, i, CASE i WHEN 0 THEN 1e9 WHEN 255 THEN -1e9 ELSE v END AS v FROM tab)
SELECT image_id, p, CASE WHEN tone <= 0 THEN false WHEN tone >= 0.999 THEN true ELSE f >= round(a.v, 6) END AS "on" FROM ff JOIN tb a ON a.label = ff.label AND a.i = CAST(round(tone * 255) AS INTEGER)""",
)
def h24_field_halftone(spark, folder):

    g = B.gray8(spark, folder)
    pts = g.select("image_id", "p", (F.col("x") * 1.37 + 0.21).alias("x"), (F.col("y") * 0.83 - 0.4).alias("y"))
    field = g.select("image_id", F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("g").alias("v"))
    f = H.sample_field(pts, field, ["image_id"], ["image_id", "p"], 8).withColumn("f", F.round("f", 6))
    tone = g.select("image_id", "p", "label", ((255 - F.col("g")) / 255.0).alias("tone"))
    table = H.area_tables(g, ["label"], "g").withColumn("v", F.round("v", 6))
    return H.threshold_test(f.join(tone, ["image_id", "p"]), table, ["label"], "tone", "f", above=True).select("image_id", "p", "on")


@query(
    "h25_coverage_grid",
    B.ctes("gray8")
    + """, o AS (SELECT CAST(range AS INTEGER) AS o FROM range(5)), n AS (SELECT vec_id AS image_id, 3 + vec_id % 3 AS gw, 4 AS gh FROM embeddings),
t AS (SELECT s.image_id, a.o AS x, b.o AS y, g / 255.0::DOUBLE AS luma, greatest(0, least((s.x + 1) * gw / 8.0::DOUBLE, a.o + 1) - greatest(s.x * gw / 8.0::DOUBLE, a.o)) * greatest(0, least((s.y + 1) * gh / 8.0::DOUBLE, b.o + 1) - greatest(s.y * gh / 8.0::DOUBLE, b.o)) AS w
  FROM gray8 s JOIN n USING (image_id), o a, o b WHERE a.o < gw AND b.o < gh)
SELECT image_id, x, y, round(sum(luma * w) / sum(w), 6) AS luma FROM t WHERE w > 1e-12 GROUP BY image_id, x, y""",
)
def h25_coverage_grid(spark, folder):
    rec = vec_images(spark, folder, 8, 8).select(
        "*", ((F.col("image_id") % 3 + 3) * 3).alias("out_width"), F.lit(12).alias("out_height"), F.lit(3.0).alias("dot_size"), F.lit(1.5).alias("min_dot")
    )
    px = B.gray8(spark, folder).select(*K, (F.col("g") / 255.0).alias("luma"))
    return H.coverage_grid(px, rec, ["luma"]).select(*K, R("luma", "luma"))


@query(
    "h26_reach",
    B.ctes("palettes") + " SELECT palette_id, greatest(4.0::DOUBLE, max(2 + (palette_id * 3 + ink * 5) % 40 / 2.0::DOUBLE)) * 1.5 AS reach FROM palettes GROUP BY palette_id",
)
def h26_reach(spark, folder):
    size = ((F.col("palette_id") * 3 + F.col("ink") * 5) % 40) / 2.0 + 2
    sizes = B.palettes(spark, folder).groupBy("palette_id").agg(F.collect_list(size).alias("sizes"))  # four inks
    return sizes.select("palette_id", H.reach(F.col("sizes")).alias("reach"))


@query(
    "h27_screen_angles",
    B.ctes("palettes") + f" SELECT palette_id, ink, {ANG} AS square, (list_value(0.0::DOUBLE, 30.0::DOUBLE, 15.0::DOUBLE, 45.0::DOUBLE))[ink + 1] AS hex, 45.0::DOUBLE AS all_45 FROM palettes",
)
def h27_screen_angles(spark, folder):
    k = F.col("ink")
    return B.palettes(spark, folder).select("palette_id", "ink", H.screen_angle("square", k).alias("square"), H.screen_angle("hex", k).alias("hex"), H.screen_angle("square", k, "All 45°").alias("all_45"))

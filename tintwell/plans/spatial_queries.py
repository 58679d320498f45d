"""Geometry, neighbourhoods, pages and borders over whole tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tintwell.functions import color as C
from tintwell.functions import geometry as G
from tintwell.operators import curves as D
from tintwell.operators import layout as LY
from tintwell.operators import spatial as SP
from tintwell.plans import sql as S
from tintwell.plans.curve_queries import R, sample_ctes
from tintwell.plans.registry import query
from tintwell.plans.split_queries import RADII, _blur_sql, _edge_sql, _gray, _GRAY, _trap_sql
from tintwell.sources import bridge as B

K = ["image_id", "x", "y"]


def vec_images(spark, folder, width: int, height: int):
    """Image records of the small vector images."""
    from tintwell.session import read_table

    return read_table(spark, folder, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(width).alias("width"), F.lit(height).alias("height"))


# ---- pixel remaps ----


@query(
    "b1_turn_crop",
    B.ctes("gray8")
    + """, t AS (SELECT image_id, g, CASE image_id % 4 WHEN 1 THEN 7 - y WHEN 2 THEN 7 - x WHEN 3 THEN y ELSE x END - 1 AS x,
  CASE image_id % 4 WHEN 1 THEN x WHEN 2 THEN 7 - y WHEN 3 THEN 7 - x ELSE y END - 2 AS y FROM gray8)
SELECT image_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, g FROM t WHERE x >= 0 AND y >= 0 AND x < 5 AND y < 6""",
)
def b1_turn_crop(spark, folder):
    records = vec_images(spark, folder, 8, 8).select(
        "*", ((F.col("image_id") % 4) * 90).cast("int").alias("turn"), *[F.lit(v).alias(n) for n, v in (("crop_x", 1), ("crop_y", 2), ("crop_w", 5), ("crop_h", 6))]
    )
    return SP.turn_crop(B.gray8(spark, folder).select(*K, "g"), records).select(*K, "g")


@query(
    "b2_straighten",
    B.ctes("gray8")
    + """, img AS (SELECT vec_id AS image_id, radians((vec_id % 91 - 45) * 0.5::DOUBLE) AS a FROM embeddings),
grid AS (SELECT image_id, CAST(px.range AS INTEGER) AS x, CAST(py.range AS INTEGER) AS y, cos(a) * (px.range + 0.5 - 4) + sin(a) * (py.range + 0.5 - 4) + 3.5 AS u,
  cos(a) * (py.range + 0.5 - 4) - sin(a) * (px.range + 0.5 - 4) + 3.5 AS v FROM img, range(8) px, range(8) py),
corner AS (SELECT image_id, x, y, least(7, greatest(0, floor(u) + i)) AS sx, least(7, greatest(0, floor(v) + j)) AS sy,
  (CASE WHEN i = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END) * (CASE WHEN j = 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END) AS w FROM grid, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j))
SELECT c.image_id, c.x, c.y, round(sum(g / 255.0::DOUBLE * w) / sum(w), 6) AS luma FROM corner c JOIN gray8 s ON s.image_id = c.image_id AND s.x = sx AND s.y = sy GROUP BY 1, 2, 3""",
)
def b2_straighten(spark, folder):
    records = vec_images(spark, folder, 8, 8).withColumn("degrees", (F.col("image_id") % 91 - 45) * 0.5)
    return SP.straighten(_gray(spark, folder), records, ["luma"]).select(*K, R("luma", "luma"))


CROPS = """crops AS (SELECT image_id, width, height, (image_id % 61 - 30) * 1.25::DOUBLE AS deg, width * (image_id % 7) / 20.0::DOUBLE AS cx, height * (image_id % 5) / 20.0::DOUBLE AS cy,
  width * (10 + image_id % 6) / 20.0::DOUBLE AS cw, height * (9 + image_id % 8) / 20.0::DOUBLE AS ch FROM images)"""


def crops(spark, folder):
    i, w, h = F.col("image_id"), F.col("width"), F.col("height")
    r = G.rect(w * (i % 7) / 20.0, h * (i % 5) / 20.0, w * (i % 6 + 10) / 20.0, h * (i % 8 + 9) / 20.0)
    return B.images(spark, folder).select("image_id", "width", "height", ((i % 61 - 30) * 1.25).alias("deg"), r.alias("r"))


def _fits_sql(x: str, y: str, w: str, h: str) -> str:
    tests = []
    for i in (0, 1):
        for j in (0, 1):
            dx, dy = f"({x} + {i} * {w} - width / 2.0::DOUBLE)", f"({y} + {j} * {h} - height / 2.0::DOUBLE)"
            tests.append(f"abs(cos(radians(deg)) * {dx} + sin(radians(deg)) * {dy}) <= width / 2.0::DOUBLE + 0.5 AND abs(cos(radians(deg)) * {dy} - sin(radians(deg)) * {dx}) <= height / 2.0::DOUBLE + 0.5")
    return "(" + " AND ".join(tests) + ")"


_HH = "least(width / 2.0::DOUBLE / (asp * abs(cos(radians(deg))) + abs(sin(radians(deg)))), height / 2.0::DOUBLE / (asp * abs(sin(radians(deg))) + abs(cos(radians(deg)))))"
_SAFE = f"safe AS (SELECT *, width / 2.0::DOUBLE - asp * hh AS sx, height / 2.0::DOUBLE - hh AS sy, 2 * asp * hh AS sw, 2 * hh AS sh FROM (SELECT *, {_HH} AS hh FROM (SELECT *, cw / ch AS asp FROM crops) a) b)"


@query("b3_fits", B.ctes("images") + f", {CROPS} SELECT image_id, {_fits_sql('cx', 'cy', 'cw', 'ch')} AS fits FROM crops")
def b3_fits(spark, folder):
    return crops(spark, folder).select("image_id", G.fits(F.col("r"), F.col("width"), F.col("height"), F.col("deg")).alias("fits"))


@query("b4_largest_rect", B.ctes("images") + f", {CROPS}, {_SAFE} SELECT image_id, round(sx, 4) AS x, round(sy, 4) AS y, round(sw, 4) AS w, round(sh, 4) AS h FROM safe")
def b4_largest_rect(spark, folder):
    df = crops(spark, folder)
    safe = df.select("image_id", G.largest_rect(F.col("width"), F.col("height"), F.col("deg"), F.col("r.w") / F.col("r.h")).alias("s"))
    return safe.select("image_id", *[R(F.col(f"s.{k}"), k, 4) for k in "xywh"])


_AT = {k: f"(s{k} + (c{k} - s{k}) * mid)" for k in "xywh"}


@query(
    "b5_keep_inside",
    B.ctes("images").replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", {CROPS}, {_SAFE}, search AS (SELECT *, 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi FROM safe
  UNION ALL SELECT * EXCLUDE (step, lo, hi, mid, ok), step + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END
  FROM (SELECT *, {_fits_sql(_AT['x'], _AT['y'], _AT['w'], _AT['h'])} AS ok FROM (SELECT *, (lo + hi) / 2 AS mid FROM search WHERE step < 30) a) b)
SELECT image_id, {", ".join(f"round(CASE WHEN {_fits_sql('cx', 'cy', 'cw', 'ch')} THEN c{k} ELSE s{k} + (c{k} - s{k}) * lo END, 3) AS {k}" for k in "xywh")} FROM search WHERE step = 30""",
)
def b5_keep_inside(spark, folder):
    df = crops(spark, folder).select("image_id", G.keep_inside(F.col("r"), F.col("width"), F.col("height"), F.col("deg")).alias("k"))
    return df.select("image_id", *[R(F.col(f"k.{c}"), c, 3) for c in "xywh"])


@query(
    "b6_resample",
    B.ctes("gray8")
    + """, o AS (SELECT CAST(range AS INTEGER) AS o FROM range(3)), t AS (SELECT image_id, a.o AS x, b.o AS y, g / 255.0::DOUBLE AS luma,
  greatest(0, least((x + 1) * 3 / 8.0::DOUBLE, a.o + 1) - greatest(x * 3 / 8.0::DOUBLE, a.o)) * greatest(0, least((y + 1) * 3 / 8.0::DOUBLE, b.o + 1) - greatest(y * 3 / 8.0::DOUBLE, b.o)) AS w FROM gray8, o a, o b)
SELECT image_id, x, y, round(sum(luma * w) / sum(w), 6) AS luma FROM t WHERE w > 1e-12 GROUP BY image_id, x, y""",
)
def b6_resample(spark, folder):
    records = vec_images(spark, folder, 8, 8).select("*", F.lit(3).alias("out_w"), F.lit(3).alias("out_h"))
    return SP.resample(_gray(spark, folder), records, ["luma"]).select(*K, R("luma", "luma"))


@query(
    "b7_pyramid",
    B.ctes("gray8")
    + """, l0 AS (SELECT image_id, x, y, g / 255.0::DOUBLE AS luma FROM gray8), l1 AS (SELECT image_id, x // 2 AS x, y // 2 AS y, avg(luma) AS luma FROM l0 GROUP BY ALL), l2 AS (SELECT image_id, x // 2 AS x, y // 2 AS y, avg(luma) AS luma FROM l1 GROUP BY ALL)
SELECT level, image_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, round(luma, 6) AS luma FROM (SELECT 0 AS level, * FROM l0 UNION ALL SELECT 1, * FROM l1 UNION ALL SELECT 2, * FROM l2) t""",
)
def b7_pyramid(spark, folder):
    out = SP.pyramid(_gray(spark, folder), vec_images(spark, folder, 8, 8), ["luma"], stop=2)
    return out.select("level", *K, R("luma", "luma"))


@query("b8_clip", B.ctes("gray8") + " SELECT image_id, x, y, g FROM gray8 WHERE x BETWEEN 1 AND 5 AND y BETWEEN 2 AND 5")
def b8_clip(spark, folder):
    return SP.clip(B.gray8(spark, folder).select(*K, "g"), 2, 3, 3, 2, 1)


def _halo_sql(size: int, margin: int) -> str:
    """Tiles of 8-pixel sides, each with the pixels within `margin` of it."""
    return (
        B.ctes("gray8")
        + f""", t AS (SELECT CAST(range AS INTEGER) AS t FROM range({-(-8 // size)}))
SELECT a.t AS tile_x, b.t AS tile_y, x // {size} = a.t AND y // {size} = b.t AS own, image_id, x, y, g FROM gray8, t a, t b
WHERE x BETWEEN a.t * {size} - {margin} AND a.t * {size} + {size - 1 + margin} AND y BETWEEN b.t * {size} - {margin} AND b.t * {size} + {size - 1 + margin}"""
    )


def _halo(spark, folder, size, margin):
    px = B.gray8(spark, folder).select(*K, "g")
    images = px.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    return SP.tile_with_halo(px, images, size, margin)


@query("b9_tile_with_halo", _halo_sql(3, 1))
def b9_tile_with_halo(spark, folder):
    return _halo(spark, folder, 3, 1)


@query("b9_full_last_tile", _halo_sql(4, 1))
def b9_full_last_tile(spark, folder):
    return _halo(spark, folder, 4, 1)


@query("b9_wide_margin", _halo_sql(2, 3))
def b9_wide_margin(spark, folder):
    return _halo(spark, folder, 2, 3)


@query(
    "b10_prune_tiles",
    B.ctes("images")
    + """, tiles AS (SELECT image_id, CAST(a.range AS INTEGER) AS tile_x, CAST(b.range AS INTEGER) AS tile_y, a.range * 512 AS x0, b.range * 512 AS y0, least(512, width - a.range * 512) AS tw, least(512, height - b.range * 512) AS th,
  width / 4.0::DOUBLE AS ax, height / 3.0::DOUBLE AS ay, width / 2.0::DOUBLE AS aw, height / 3.0::DOUBLE AS ah FROM images, range(9) a, range(7) b WHERE a.range * 512 < width AND b.range * 512 < height)
SELECT image_id, tile_x, tile_y, CASE WHEN x0 >= ax + aw OR x0 + tw <= ax OR y0 >= ay + ah OR y0 + th <= ay THEN 1.0::DOUBLE ELSE tw * th / 512.0::DOUBLE / 512 END AS v FROM tiles""",
)
def b10_prune_tiles(spark, folder):
    tiles = SP.tile_plan(B.images(spark, folder).select("image_id", "width", "height"), 512)
    w, h = F.col("width"), F.col("height")
    tiles = tiles.withColumn("missed", SP.misses_art(w / 4.0, h / 3.0, w / 2.0, h / 3.0))
    rendered = tiles.select("image_id", "tile_x", "tile_y", (F.col("tw") * F.col("th") / 512.0 / 512).alias("v"))
    return SP.prune_tiles(tiles, rendered, 1.0)


# ---- pages and borders ----

_MODES = {
    "mode": ("CASE WHEN k % 3 = 0 THEN 'digital' ELSE 'print' END", lambda k: F.when(k % 3 == 0, "digital").otherwise("print")),
    "digital_size": ("(['half','original','double','triple','custom'])[k % 5 + 1]", lambda k: F.get(F.array(*[F.lit(v) for v in ("half", "original", "double", "triple", "custom")]), k % 5)),
    "lock_aspect": ("k % 2 = 0", lambda k: k % 2 == 0),
    "digital_width": ("500 + k % 700", lambda k: k % 700 + 500),
    "digital_height": ("300 + k % 900", lambda k: k % 900 + 300),
    "digital_fit": ("CASE WHEN k % 7 < 3 THEN 'fill' ELSE 'fit' END", lambda k: F.when(k % 7 < 3, "fill").otherwise("fit")),
    "dpi": ("(list_value(300, 600, 1200, 4000))[k % 4 + 1]", lambda k: F.get(F.array(F.lit(300), F.lit(600), F.lit(1200), F.lit(4000)), k % 4)),
    "units": ("CASE WHEN k % 2 = 0 THEN 'mm' ELSE 'in' END", lambda k: F.when(k % 2 == 0, "mm").otherwise("in")),
    "page_size": ("(['letter','legal','tabloid','a4','a3','b4','custom','image'])[k % 8 + 1]", lambda k: F.get(F.array(*[F.lit(v) for v in ("letter", "legal", "tabloid", "a4", "a3", "b4", "custom", "image")]), k % 8)),
    "page_width": ("(CASE WHEN k % 2 = 0 THEN 150 + k % 90 ELSE 5 + k % 7 END)::DOUBLE", lambda k: F.when(k % 2 == 0, k % 90 + 150).otherwise(k % 7 + 5).cast("double")),
    "page_height": ("(CASE WHEN k % 2 = 0 THEN 140 + k % 110 ELSE 4 + k % 9 END)::DOUBLE", lambda k: F.when(k % 2 == 0, k % 110 + 140).otherwise(k % 9 + 4).cast("double")),
    "orientation": ("CASE WHEN k % 5 < 2 THEN 'landscape' ELSE 'portrait' END", lambda k: F.when(k % 5 < 2, "landscape").otherwise("portrait")),
    "bleed_mm": ("(k % 4)::DOUBLE", lambda k: (k % 4).cast("double")),
    "margin_mm": ("(k % 13)::DOUBLE", lambda k: (k % 13).cast("double")),
    "placement": ("(['fit','fill','custom'])[k % 3 + 1]", lambda k: F.get(F.array(F.lit("fit"), F.lit("fill"), F.lit("custom")), k % 3)),
    "image_width": ("(CASE WHEN k % 2 = 0 THEN 80 + k % 60 ELSE 3 + k % 4 END)::DOUBLE", lambda k: F.when(k % 2 == 0, k % 60 + 80).otherwise(k % 4 + 3).cast("double")),
    "position_x": ("k % 101", lambda k: k % 101),
    "position_y": ("k % 67", lambda k: k % 67),
    "print_target": ("CASE WHEN k % 4 = 1 THEN 'standard' ELSE 'riso' END", lambda k: F.when(k % 4 == 1, "standard").otherwise("riso")),
    "file_format": ("CASE WHEN k % 6 < 4 THEN 'pdf' ELSE 'png' END", lambda k: F.when(k % 6 < 4, "pdf").otherwise("png")),
    "digital_format": ("CASE WHEN k % 2 = 0 THEN 'jpg' ELSE 'png' END", lambda k: F.when(k % 2 == 0, "jpg").otherwise("png")),
    "frame": ("(['none','ink','paper'])[k % 3 + 1]", lambda k: F.get(F.array(F.lit("none"), F.lit("ink"), F.lit("paper")), k % 3)),
    "thickness": ("((k % 101) - 50) / 2.0::DOUBLE", lambda k: (k % 101 - 50) / 2.0),
    "corner": ("(k % 51)::DOUBLE", lambda k: (k % 51).cast("double")),
    "frame_ink": ("CAST(k % 5 AS INTEGER)", lambda k: (k % 5).cast("int")),
    "ink_count": ("CAST(1 + k % 4 AS INTEGER)", lambda k: (k % 4 + 1).cast("int")),
    "crop_marks": ("k % 3 < 2", lambda k: k % 3 < 2),
    "reg_marks": ("k % 5 < 4", lambda k: k % 5 < 4),
    "layer_labels": ("k % 7 < 5", lambda k: k % 7 < 5),
}
SETUPS = "setups AS (SELECT image_id, width, height, " + ", ".join(f"{s} AS {n}" for n, (s, _) in _MODES.items()) + " FROM (SELECT *, CAST((image_id * 7 + n_chars) % 9973 AS INTEGER) AS k FROM images) t)"
BORDERS = """borders AS (SELECT * EXCLUDE (unit, t), greatest(0.0::DOUBLE, t) AS margin, least(greatest(0.0::DOUBLE, -t), least(width, height) / 2.0::DOUBLE) AS inset,
  CASE WHEN frame = 'none' THEN 0 ELSE least(corner * unit, (least(width, height) - 2 * least(greatest(0.0::DOUBLE, -t), least(width, height) / 2.0::DOUBLE)) / 2) END AS radius,
  CASE frame WHEN 'ink' THEN 1 WHEN 'paper' THEN 2 ELSE 0 END AS bmode, greatest(0, least(ink_count - 1, frame_ink)) AS ink
  FROM (SELECT *, CASE WHEN frame = 'none' THEN 0.0::DOUBLE ELSE thickness * unit END AS t FROM (SELECT *, least(width, height) / 100.0::DOUBLE AS unit FROM setups) a) b)"""


def setups(spark, folder):
    img = B.images(spark, folder).withColumn("k", ((F.col("image_id") * 7 + F.col("n_chars")) % 9973).cast("int"))
    df = img.select("image_id", "width", "height", *[fn(F.col("k")).alias(n) for n, (_, fn) in _MODES.items()])
    border = G.border_geometry(F.col("width"), F.col("height"), F.col("frame"), F.col("thickness"), F.col("corner"), F.col("frame_ink"), F.col("ink_count"))
    return df.withColumn("border", border).withColumn("margin", F.col("border.margin"))


PAGES_SQL = "pages_mm(page, pw, ph) AS (VALUES " + ", ".join(f"('{k}', {w}::DOUBLE, {h}::DOUBLE)" for k, (w, h) in LY.PAGES.items()) + ")"
_PX = "(CASE WHEN units = 'mm' THEN {0} / 25.4::DOUBLE ELSE {0} END * dpi)"
LAYOUT = f"""{SETUPS}, {BORDERS}, {PAGES_SQL},
y0 AS (SELECT b.*, width + 2 * margin AS a, height + 2 * margin AS b, mode = 'print' AND page_size <> 'image' AS page, bleed_mm / 25.4::DOUBLE * dpi AS bleed,
  CASE WHEN page_size = 'custom' THEN {_PX.format('page_width')} ELSE pw / 25.4::DOUBLE * dpi END AS pw0, CASE WHEN page_size = 'custom' THEN {_PX.format('page_height')} ELSE ph / 25.4::DOUBLE * dpi END AS ph0
  FROM borders b LEFT JOIN pages_mm ON page_size = pages_mm.page),
y1 AS (SELECT *, CASE WHEN (orientation = 'landscape') <> (pw0 > ph0) THEN ph0 ELSE pw0 END AS pgw, CASE WHEN (orientation = 'landscape') <> (pw0 > ph0) THEN pw0 ELSE ph0 END AS pgh,
  greatest(1, {_PX.format('image_width')}) / a AS placed, mode = 'digital' AND digital_size = 'custom' AND NOT lock_aspect AS free FROM y0),
y2 AS (SELECT *, least(margin_mm / 25.4::DOUBLE * dpi, pgw / 2 - 1, pgh / 2 - 1) AS m, CASE WHEN free THEN CASE digital_fit WHEN 'fill' THEN greatest(digital_width / a, digital_height / b) ELSE least(digital_width / a, digital_height / b) END
  WHEN mode = 'print' THEN placed WHEN digital_size = 'custom' THEN digital_width / a ELSE (CASE digital_size WHEN 'half' THEN 0.5 WHEN 'double' THEN 2 WHEN 'triple' THEN 3 ELSE 1 END)::DOUBLE END AS s0 FROM y1),
y3 AS (SELECT *, pgw - 2 * m AS qw, pgh - 2 * m AS qh, bleed + m AS q, CAST(CASE WHEN page THEN greatest(1, floor(pgw + 2 * bleed + 0.5)) WHEN free THEN digital_width ELSE greatest(1, floor(a * s0 + 0.5)) END AS BIGINT) AS ow,
  CAST(CASE WHEN page THEN greatest(1, floor(pgh + 2 * bleed + 0.5)) WHEN free THEN digital_height ELSE greatest(1, floor(b * s0 + 0.5)) END AS BIGINT) AS oh FROM y2),
y4 AS (SELECT *, CASE WHEN NOT page THEN s0 WHEN placement = 'fill' THEN greatest(ow / a, oh / b) WHEN placement = 'custom' THEN placed ELSE greatest(1e-3, least(qw / a, qh / b)) END AS s FROM y3),
laid AS (SELECT *, CASE WHEN free OR (page AND placement = 'fill') THEN (ow - a * s) / 2 WHEN NOT page THEN 0 WHEN placement = 'custom' THEN q + (qw - a * s) * position_x / 100.0::DOUBLE ELSE q + (qw - a * s) / 2 END AS ax,
  CASE WHEN free OR (page AND placement = 'fill') THEN (oh - b * s) / 2 WHEN NOT page THEN 0 WHEN placement = 'custom' THEN q + (qh - b * s) * position_y / 100.0::DOUBLE ELSE q + (qh - b * s) / 2 END AS ay FROM y4)"""


@query(
    "b11_output_layout",
    B.ctes("images")
    + f""", {LAYOUT} SELECT image_id, mode AS kind, ow AS width, oh AS height, round(s, 6) AS scale, round(ax, 3) AS art_x, round(ay, 3) AS art_y, round(a * s, 3) AS art_w, round(b * s, 3) AS art_h,
  round(CASE WHEN page AND placement = 'fill' THEN bleed ELSE ax END, 3) AS cut_x, round(CASE WHEN page THEN q END, 3) AS print_x, round(CASE WHEN page THEN qw END, 3) AS print_w,
  round(ax + margin * s, 3) AS image_x, round(ay + margin * s, 3) AS image_y, round(CASE WHEN page THEN pgw ELSE ow END, 3) AS trim_w FROM laid""",
)
def b11_output_layout(spark, folder):
    laid = LY.output_layout(setups(spark, folder))
    l = lambda p, n, d=3: R(F.col(f"layout.{p}"), n, d)
    return laid.select(
        "image_id", "layout.kind", "layout.width", "layout.height", l("scale", "scale", 6), l("art.x", "art_x"), l("art.y", "art_y"), l("art.w", "art_w"), l("art.h", "art_h"),
        l("cut.x", "cut_x"), l("printable.x", "print_x"), l("printable.w", "print_w"), l("image_x", "image_x"), l("image_y", "image_y"), l("trim.w", "trim_w"),
    )


@query(
    "a9_export_plan",
    B.ctes("images")
    + f""", {LAYOUT}, k AS (SELECT *, CASE WHEN mode = 'digital' THEN 'digital' WHEN print_target = 'standard' THEN 'standard' ELSE 'riso' END AS kind,
  CASE WHEN mode = 'print' THEN CASE WHEN file_format = 'pdf' THEN 'pdf' ELSE 'png' END WHEN digital_format = 'jpg' THEN 'jpg' ELSE 'png' END AS format FROM laid)
SELECT image_id, kind, format, ow AS width, oh AS height, CASE WHEN greatest(ow, oh) > 32768 OR ow * oh > 1000000000 THEN 'too large' WHEN format = 'pdf' AND greatest(ow, oh) / dpi::DOUBLE > 200 THEN 'pdf page too large'
  WHEN format = 'jpg' AND (ow * oh > 120000000 OR greatest(ow, oh) > 16384) THEN 'jpg too large' END AS problem FROM k""",
)
def a9_export_plan(spark, folder):
    plan = LY.export_plan(LY.output_layout(setups(spark, folder)))
    return plan.select("image_id", "kind", "format", "layout.width", "layout.height", "problem")


@query(
    "b12_border_geometry",
    B.ctes("images") + f""", {SETUPS}, {BORDERS} SELECT image_id, round(margin, 6) AS margin, round(inset, 6) AS x0, round(width - inset, 6) AS x1, round(height - inset, 6) AS y1, round(radius, 6) AS radius, bmode AS mode, ink FROM borders""",
)
def b12_border_geometry(spark, folder):
    b = setups(spark, folder).select("image_id", "border.*")
    return b.select("image_id", R("margin", "margin"), R("x0", "x0"), R("x1", "x1"), R("y1", "y1"), R("radius", "radius"), "mode", "ink")


def _sdf_sql(px: str, py: str, x0: str, y0: str, x1: str, y1: str, r: str) -> str:
    qx, qy = f"(abs({px} - ({x0} + {x1}) * 0.5) - ({x1} - {x0}) * 0.5 + {r})", f"(abs({py} - ({y0} + {y1}) * 0.5) - ({y1} - {y0}) * 0.5 + {r})"
    return f"(sqrt(pow(greatest({qx}, 0), 2) + pow(greatest({qy}, 0), 2)) + least(greatest({qx}, {qy}), 0) - {r})"


@query("b13_rounded_rect_sdf", B.ctes("gray8") + f""" SELECT image_id, x, y, round({_sdf_sql('(x + 0.5::DOUBLE)', '(y + 0.5::DOUBLE)', '1.0::DOUBLE', '1.5::DOUBLE', '7.0::DOUBLE', '6.5::DOUBLE', '((image_id % 5) / 2.0::DOUBLE)')}, 6) AS sdf FROM gray8""")
def b13_rounded_rect_sdf(spark, folder):
    n = F.lit
    sdf = G.rounded_rect_sdf(F.col("x") + 0.5, F.col("y") + 0.5, n(1.0), n(1.5), n(7.0), n(6.5), (F.col("image_id") % 5) / 2.0)
    return B.gray8(spark, folder).select(*K, R(sdf, "sdf"))


FADES = """fades AS (SELECT vec_id AS image_id, (['linear','smooth','exponential','custom'])[CAST(vec_id % 4 AS INTEGER) + 1] AS kind, 30 + vec_id % 41 AS midpoint FROM embeddings)"""


def fades(spark, folder):
    from tintwell.session import read_table

    v = F.col("vec_id")
    kinds = F.array(*[F.lit(k) for k in ("linear", "smooth", "exponential", "custom")])
    return read_table(spark, folder, "embeddings").select(v.alias("image_id"), F.get(kinds, (v % 4).cast("int")).alias("kind"), (v % 41 + 30).alias("midpoint"))


def _base_sql(x: str) -> str:
    return f"CASE kind WHEN 'linear' THEN 1 - {x} WHEN 'smooth' THEN 1 - {x} * {x} * (3 - {x} * 2) WHEN 'exponential' THEN 1 - (exp(4 * {x}) - 1) / (exp(4.0::DOUBLE) - 1) ELSE s.v END"


FADE_LUT = (
    sample_ctes(1024, out="custom")
    + f""", {FADES}, grid AS (SELECT f.*, q.range AS i, q.range / 1024.0::DOUBLE AS px FROM fades f, range(1025) q),
gy AS (SELECT g.image_id, g.i, g.px, {_base_sql('g.px')} - 0.5 AS y FROM grid g LEFT JOIN custom s ON s.curve_id = g.image_id AND s.i = CAST(floor(g.px * 1023 + 0.5) AS INTEGER)),
cr AS (SELECT *, lag(y) OVER w AS y0, lag(px) OVER w AS x0 FROM gy WINDOW w AS (PARTITION BY image_id ORDER BY i)),
halves AS (SELECT image_id, arg_min(CASE WHEN y0 = 0 THEN x0 ELSE x0 + (px - x0) * y0 / (y0 - y) END, i) AS half FROM cr WHERE i > 0 AND (y0 = 0 OR (y0 > 0 AND y <= 0) OR (y0 < 0 AND y >= 0)) GROUP BY image_id),
ent AS MATERIALIZED (SELECT f.*, CAST(q.range AS INTEGER) AS i, pow(q.range / 255.0::DOUBLE, ln(least(0.999::DOUBLE, greatest(0.001::DOUBLE, coalesce(half, 0.5)))) / ln(least(0.95::DOUBLE, greatest(0.05::DOUBLE, midpoint / 100.0::DOUBLE)))) AS px
  FROM fades f LEFT JOIN halves USING (image_id), range(256) q),
fade_lut AS (SELECT e.image_id, e.i, CASE e.i WHEN 0 THEN 1.0::DOUBLE WHEN 255 THEN 0 ELSE {S.clamp01(_base_sql('e.px'))} END AS v FROM ent e LEFT JOIN custom s ON s.curve_id = e.image_id AND s.i = CAST(floor(e.px * 1023 + 0.5) AS INTEGER))"""
)


def fade_curves(spark, folder):
    return D.sample_curves(B.curve_points(spark, folder), ["curve_id"], 1024).withColumnRenamed("curve_id", "image_id")


@query("b14_fade_lut", B.ctes("curve_points").replace("WITH ", "WITH RECURSIVE ", 1) + f",\n{FADE_LUT} SELECT image_id, i, round(v, 6) AS v FROM fade_lut")
def b14_fade_lut(spark, folder):
    return LY.fade_luts(fades(spark, folder), fade_curves(spark, folder), ["image_id"]).select("image_id", "i", R("v", "v"))


@query(
    "b15_apply_fade",
    B.ctes("curve_points", "rgb21").replace("WITH ", "WITH RECURSIVE ", 1)
    + f""",\n{FADE_LUT}, fp AS (SELECT image_id, x, y, r / 255.0::DOUBLE AS sr, g / 255.0::DOUBLE AS sg, b / 255.0::DOUBLE AS sb, (image_id % 2)::DOUBLE AS tint, -{_sdf_sql('(x + 0.5::DOUBLE)', '(y + 0.5::DOUBLE)', '0.0::DOUBLE', '0.0::DOUBLE', '7.0::DOUBLE', '3.0::DOUBLE', '0.5::DOUBLE')} / 1.25::DOUBLE AS d FROM rgb21),
fq AS (SELECT *, {S.clamp01('d')} * 255 AS pos FROM fp), q7 AS (SELECT image_id, i, floor(v * 255 + 0.5) / 255.0::DOUBLE AS v FROM fade_lut),
q8 AS MATERIALIZED (SELECT *, coalesce(lead(v) OVER (PARTITION BY image_id ORDER BY i), v) AS w FROM q7),
fk AS (SELECT f.*, CASE WHEN d <= 0 THEN 1 WHEN d >= 1 THEN 0 ELSE v + (w - v) * (pos - floor(pos)) END * 0.8::DOUBLE AS k FROM fq f JOIN q8 a ON a.image_id = f.image_id AND a.i = CAST(floor(pos) AS INTEGER))
SELECT image_id, x, y, round(sr + (tint - sr) * k, 5) AS sr, round(sg + (tint - sg) * k, 5) AS sg, round(sb + (tint - sb) * k, 5) AS sb FROM fk""",
)
def b15_apply_fade(spark, folder):
    px = B.rgb21(spark, folder).select(*K, *[(F.col(c) / 255.0).alias(f"s{c}") for c in "rgb"])
    records = vec_images(spark, folder, 7, 3).select(
        "image_id", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(7.0).alias("x1"), F.lit(3.0).alias("y1"), F.lit(0.5).alias("radius"),
        F.lit(1.25).alias("distance"), (F.col("image_id") % 2).cast("double").alias("tint"), F.lit(0.8).alias("opacity"),
    )
    out = LY.apply_fade(px, records, LY.fade_tables(fades(spark, folder), fade_curves(spark, folder), ["image_id"]))
    return out.select(*K, *[R(c, c, 5) for c in ("sr", "sg", "sb")])


@query(
    "b16_apply_frame",
    B.ctes("coverage")
    + f""", t AS (SELECT *, image_id % 3 AS fm, {_sdf_sql('(x + 0.5::DOUBLE)', '(y + 0.5::DOUBLE)', '0.8::DOUBLE', '0.8::DOUBLE', '3.2::DOUBLE', '3.2::DOUBLE', '0.4::DOUBLE')} AS d FROM coverage)
SELECT image_id, x, y, {", ".join(f"round(CASE WHEN fm <> 0 AND d > 0 THEN CASE WHEN fm = 1 AND least(3, image_id % 5) = {k} THEN 1 ELSE 0 END ELSE c{k} END, 6) AS c{k}" for k in range(4))} FROM t""",
)
def b16_apply_frame(spark, folder):
    i = F.col("image_id")
    frame = F.when(i % 3 == 1, "ink").when(i % 3 == 2, "paper").otherwise("none")
    g = G.border_geometry(F.lit(4.0), F.lit(4.0), frame, F.lit(-20.0), F.lit(10.0), (i % 5).cast("int"), F.lit(4))
    records = vec_images(spark, folder, 4, 4).select("image_id", g.alias("border"))
    return LY.apply_frame(B.coverage(spark, folder), records).select(*K, *[R(f"c{k}", f"c{k}") for k in range(4)])


def _mm(v: float) -> str:
    return f"({v / LY.MM_PER_INCH!r}::DOUBLE * dpi)"


def _on(x: str, y: str) -> str:
    return f"({x} >= 0 AND {y} >= 0 AND {x} <= ow AND {y} <= oh)"


def _marks_sql() -> str:
    parts = []
    for xc, yc, dx, dy in (("x0", "y0", -1, -1), ("x1", "y0", 1, -1), ("x0", "y1", -1, 1), ("x1", "y1", 1, 1)):
        a, b = f"({xc} + gap * {dx})", f"({xc} + (gap + {_mm(5)}) * {dx})"
        parts.append(f"SELECT image_id, 'line' AS kind, {a} AS mx0, {yc} AS my0, {b} AS mx1, {yc} AS my1, CAST(NULL AS INTEGER) AS layer FROM mk WHERE crop_marks AND {_on(f'least({a}, {b})', yc)} AND {_on(f'greatest({a}, {b})', yc)}")
        a, b = f"({yc} + gap * {dy})", f"({yc} + (gap + {_mm(5)}) * {dy})"
        parts.append(f"SELECT image_id, 'line', {xc}, {a}, {xc}, {b}, NULL FROM mk WHERE crop_marks AND {_on(xc, f'least({a}, {b})')} AND {_on(xc, f'greatest({a}, {b})')}")
    rc = _mm(3.75)
    for x, y in (("(x0 + x1) / 2", f"y0 - (gap + {rc})"), ("(x0 + x1) / 2", f"y1 + gap + {rc}"), (f"x0 - (gap + {rc})", "(y0 + y1) / 2"), (f"x1 + gap + {rc}", "(y0 + y1) / 2")):
        parts.append(f"SELECT image_id, 'target', {x} - {rc}, {y} - {rc}, {x} + {rc}, {y} + {rc}, NULL FROM mk WHERE reg_marks AND print_target = 'riso' AND {_on(f'({x} - {rc})', f'({y} - {rc})')} AND {_on(f'({x} + {rc})', f'({y} + {rc})')}")
    size, extra = _mm(2.5), f"(CASE WHEN reg_marks THEN {_mm(8.5)} ELSE 0 END)"
    base = f"(CASE WHEN y1 + gap + {extra} + {size} + {size} * 0.3 <= oh THEN y1 + gap + {extra} + {size} WHEN y0 - gap - {extra} - {size} >= 0 THEN y0 - gap - {extra} END)"
    parts.append(f"SELECT image_id, 'label', greatest(x0, gap), {base} - {size}, greatest(x0, gap), {base}, CAST(k.range AS INTEGER) FROM mk, range(4) k WHERE layer_labels AND print_target = 'riso' AND k.range < ink_count AND {base} IS NOT NULL")
    return " UNION ALL ".join(parts)


MARKS = f"""{LAYOUT}, mk AS (SELECT *, greatest({_mm(1.5)}, CASE WHEN placement = 'fill' THEN bleed + {_mm(1)} ELSE 0 END) AS gap, CASE WHEN placement = 'fill' THEN bleed ELSE ax END AS x0, CASE WHEN placement = 'fill' THEN bleed ELSE ay END AS y0,
  CASE WHEN placement = 'fill' THEN bleed + pgw ELSE ax + a * s END AS x1, CASE WHEN placement = 'fill' THEN bleed + pgh ELSE ay + b * s END AS y1 FROM laid WHERE page), marks AS ({_marks_sql()})"""


@query("b17_marks", B.ctes("images") + f", {MARKS} SELECT image_id, kind, round(mx0, 3) AS x0, round(my0, 3) AS y0, round(mx1, 3) AS x1, round(my1, 3) AS y1, layer FROM marks")
def b17_marks(spark, folder):
    m = LY.marks(LY.output_layout(setups(spark, folder)))
    return m.select("image_id", "kind", *[R(c, c, 3) for c in ("x0", "y0", "x1", "y1")], "layer")


@query(
    "b17_stamp",
    B.ctes("coverage")
    + f""", t AS (SELECT *, abs(y + 0.5 - 1.5) <= 0.5 AND x + 0.5 >= 1 AND x < 3 OR (image_id % 2 = 1 AND abs(x + 0.5 - 2.2::DOUBLE) <= 0.5) AS hit FROM coverage)
SELECT image_id, x, y, {", ".join(f"round(CASE WHEN hit THEN 1 ELSE c{k} END, 6) AS c{k}" for k in range(4))} FROM t""",
)
def b17_stamp(spark, folder):
    rows = vec_images(spark, folder, 4, 4)
    line = lambda x0, y0, x1, y1: F.struct(F.lit("line").alias("kind"), F.lit(x0).alias("x0"), F.lit(y0).alias("y0"), F.lit(x1).alias("x1"), F.lit(y1).alias("y1"))
    across, down = line(1.0, 1.5, 3.0, 1.5), line(2.2, 0.0, 2.2, 4.0)
    shapes = F.when(F.col("image_id") % 2 == 1, F.array(across, down)).otherwise(F.array(across))
    drawn = rows.select("image_id", F.lit(100).alias("dpi"), F.explode(shapes).alias("m")).select("image_id", "dpi", "m.*")
    return LY.stamp(B.coverage(spark, folder), LY.mark_pixels(drawn)).select(*K, *[R(f"c{k}", f"c{k}") for k in range(4)])


@query(
    "b18_sample_at",
    B.ctes("rgb21")
    + f""", {S.linear_cte('t', 'rgb21')}, pts AS (SELECT DISTINCT image_id, CAST(p.range AS INTEGER) AS point, CAST((image_id + p.range * 3) % 7 AS INTEGER) AS px, CAST((image_id + p.range) % 3 AS INTEGER) AS py FROM rgb21, range(2) p),
m AS (SELECT p.image_id, point, avg(lr) AS lr, avg(lg) AS lg, avg(lb) AS lb FROM pts p JOIN t ON t.image_id = p.image_id AND abs(t.x - px) <= 1 AND abs(t.y - py) <= 1 WHERE (t.x + t.y + t.image_id) % 5 > 0 GROUP BY 1, 2)
SELECT image_id, point, {S.to_hex(S.byte('lr'), S.byte('lg'), S.byte('lb'))} AS hex FROM m""",
)
def b18_sample_at(spark, folder):
    i = F.col("image_id")
    px = B.rgb21(spark, folder).withColumn("a", ((F.col("x") + F.col("y") + i) % 5).cast("int"))
    pts = vec_images(spark, folder, 7, 3).select("image_id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("point"))
    pts = pts.select("image_id", "point", ((i + F.col("point") * 3) % 7).cast("int").alias("px"), ((i + F.col("point")) % 3).cast("int").alias("py"))
    return SP.sample_at(px, pts)


# ---- filters ----


def _bilateral_sql(name: str, src: str, axis: str, sigma: float) -> str:
    side = 6 if axis == "x" else 2
    offs = ", ".join(f"({d})" for d in range(-math.ceil(2.5 * sigma), math.ceil(2.5 * sigma) + 1))
    other = "y" if axis == "x" else "x"
    e = {c: S.srgb(f"n.{c}") + " - " + S.srgb(f"c.{c}") for c in "rgb"}
    w = f"exp(-(d * d) / {2 * sigma * sigma!r}::DOUBLE - (pow({e['r']}, 2) + pow({e['g']}, 2) + pow({e['b']}, 2)) / {2 * 0.12 * 0.12!r}::DOUBLE)"
    return f"""{name} AS (SELECT image_id, x, y, {", ".join(f"sum({c} * w) / sum(w) AS {c}" for c in "rgb")} FROM (
  SELECT c.image_id, c.x, c.y, n.r, n.g, n.b, {w} AS w FROM {src} c CROSS JOIN (VALUES {offs}) o(d) JOIN {src} n ON n.image_id = c.image_id AND n.{other} = c.{other} AND n.{axis} = least({side}, greatest(0, c.{axis} + d))) q GROUP BY image_id, x, y)"""


@query(
    "f1_bilateral",
    B.ctes("rgb21")
    + f", {S.linear_cte('t', 'rgb21')}, p AS (SELECT image_id, x, y, lr AS r, lg AS g, lb AS b FROM t), {_bilateral_sql('h', 'p', 'x', 0.8)}, {_bilateral_sql('v', 'h', 'y', 0.8)} SELECT image_id, x, y, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM v",
)
def f1_bilateral(spark, folder):
    px = B.rgb21(spark, folder)
    lin = C.rgb_to_linear((F.col("r"), F.col("g"), F.col("b")))
    out = SP.bilateral(px.select(*K, *[c.alias(n) for c, n in zip(lin, "rgb")]), 0.8)
    return out.select(*K, R("r", "r"), R("g", "g"), R("b", "b"))


@query("f2_sobel", B.ctes("gray8") + f", {_GRAY}, {_edge_sql()} SELECT image_id, x, y, round(gx, 6) AS gx, round(gy, 6) AS gy FROM edges")
def f2_sobel(spark, folder):
    return SP.sobel(_gray(spark, folder), "luma").select(*K, R("gx", "gx"), R("gy", "gy"))


def _blur3(name: str, src: str, axis: str) -> str:
    parts = [_blur_sql(f"{name}_{v}", src, v, 0.8, axis) for v in ("cos2", "sin2", "strength")]
    return ", ".join(parts) + f", {name} AS (SELECT * FROM {name}_cos2 JOIN {name}_sin2 USING (image_id, x, y) JOIN {name}_strength USING (image_id, x, y))"


@query(
    "f3_orientation",
    B.ctes("rgb21")
    + f""", {S.linear_cte('t', 'rgb21')}, lum AS (SELECT image_id, x, y, {S.LUMA.format('lr', 'lg', 'lb')} AS luma FROM t), {_edge_sql('luma', 'lum')},
c AS (SELECT image_id, x, y, least(1, greatest(-1, gx)) AS gx, least(1, greatest(-1, gy)) AS gy FROM edges),
ten AS (SELECT image_id, x, y, cos(2 * atan2(gy, gx)) * m AS cos2, sin(2 * atan2(gy, gx)) * m AS sin2, m AS strength FROM (SELECT *, {S.clamp01('sqrt(gx * gx + gy * gy) * 3')} AS m FROM c) q),
{_blur3('bh', 'ten', 'x')}, {_blur3('bv', 'bh', 'y')}
SELECT image_id, x, y, round(cos2, 5) AS cos2, round(sin2, 5) AS sin2, round(strength, 5) AS strength, round(CASE WHEN strength > 1e-3 THEN sqrt(cos2 * cos2 + sin2 * sin2) / strength ELSE 0 END, 5) AS coherence FROM bv""",
)
def f3_orientation(spark, folder):
    px = B.rgb21(spark, folder)
    lin = C.rgb_to_linear((F.col("r"), F.col("g"), F.col("b")))
    out = SP.orientation(px.select(*K, *[c.alias(n) for c, n in zip(lin, "rgb")]), 0.8)
    return out.select(*K, *[R(c, c, 5) for c in ("cos2", "sin2", "strength", "coherence")])


@query("f4_gaussian", B.ctes("gray8") + f", {_GRAY}, {_blur_sql('bx', 'gpx', 'luma', 1.2, 'x')}, {_blur_sql('blurred', 'bx', 'luma', 1.2, 'y')} SELECT image_id, x, y, round(luma, 6) AS luma FROM blurred")
def f4_gaussian(spark, folder):
    return SP.gaussian(_gray(spark, folder), ["luma"], 1.2).select(*K, R("luma", "luma"))


def _wrap_sql(name: str, src: str, axis: str, sigma: float) -> str:
    r = math.ceil(sigma * 3)
    ws = [(d, math.exp(-(d * d) / (2 * sigma * sigma))) for d in range(-r, r + 1)]
    total = sum(w for _, w in ws)
    vals = ", ".join(f"({d}, {w / total!r}::DOUBLE)" for d, w in ws)
    other = "y" if axis == "x" else "x"
    return f"{name} AS (SELECT image_id, {other}, ({axis} + d + 64) % 8 AS {axis}, sum(luma * w) AS luma FROM {src}, (VALUES {vals}) k(d, w) GROUP BY 1, 2, 3)"


@query("f4_gaussian_wrapped", B.ctes("gray8") + f", {_GRAY}, {_wrap_sql('wx', 'gpx', 'x', 1.0)}, {_wrap_sql('wy', 'wx', 'y', 1.0)} SELECT image_id, CAST(x AS INTEGER) AS tx, CAST(y AS INTEGER) AS ty, round(luma, 6) AS luma FROM wy")
def f4_gaussian_wrapped(spark, folder):
    tile = _gray(spark, folder).withColumnsRenamed({"x": "tx", "y": "ty"})
    return SP.gaussian_wrapped(tile, ["image_id"], "luma", 1.0, 8).select("image_id", "tx", "ty", R("luma", "luma"))


@query(
    "f5_trap",
    B.ctes("coverage") + f", {_trap_sql('t1', 'coverage', RADII, 'x')}, {_trap_sql('t2', 't1', RADII, 'y')} SELECT image_id, x, y, round(c0, 6) AS c0, round(c1, 6) AS c1, round(c2, 6) AS c2, round(c3, 6) AS c3 FROM t2",
)
def f5_trap(spark, folder):
    return SP.trap(B.coverage(spark, folder), RADII).select(*K, *[R(f"c{k}", f"c{k}") for k in range(4)])


TILES = "tiles AS (SELECT image_id, x AS tx, y AS ty, (row_number() OVER (PARTITION BY image_id ORDER BY g, p) - 0.5::DOUBLE) / 64 AS threshold FROM gray8)"


def tiles(spark, folder):
    """An 8x8 threshold tile per image: its pixels ranked by value."""
    from pyspark.sql import Window

    w = Window.partitionBy("image_id").orderBy("g", "p")  # 64 cells per tile
    return B.gray8(spark, folder).select("image_id", F.col("x").alias("tx"), F.col("y").alias("ty"), ((F.row_number().over(w) - 0.5) / 64).alias("threshold"))


REACH = f"""{TILES}, pts AS (SELECT image_id, tx, ty, CAST(a.range AS INTEGER) AS sx, CAST(b.range AS INTEGER) AS sy FROM tiles, range(4) a, range(4) b), off AS (SELECT a.range - 1 AS dx, b.range - 1 AS dy FROM range(3) a, range(3) b),
reach AS (SELECT p.image_id, p.tx, p.ty, sx, sy, min(t.threshold) AS reach FROM pts p, off JOIN tiles t ON t.image_id = p.image_id AND t.tx = (p.tx + dx + 8) % 8 AND t.ty = (p.ty + dy + 8) % 8
  WHERE pow((sx + 0.5) / 4 - dx - 0.5, 2) + pow((sy + 0.5) / 4 - dy - 0.5, 2) <= 0.5 GROUP BY 1, 2, 3, 4, 5)"""


@query("f6_disc_reach", B.ctes("gray8") + f", {REACH} SELECT image_id, tx, ty, sx, sy, reach FROM reach")
def f6_disc_reach(spark, folder):
    return SP.disc_reach(tiles(spark, folder), ["image_id"], 8)

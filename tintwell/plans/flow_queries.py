"""Whole chains: registered split methods and halftones, and pixels to print colours."""

from __future__ import annotations

from pyspark.sql import functions as F

from tintwell import plugins
from tintwell.functions import color as C
from tintwell.operators import layers as L
from tintwell.operators import mix as M
from tintwell.operators import split as E
from tintwell.plans import sql as S
from tintwell.plans.curve_queries import R
from tintwell.plans.halftone_queries import cov_long, points
from tintwell.plans.registry import ORACLES, query
from tintwell.plans.split_queries import COV, FIXED, RANGES, TONE, _channel_sql, _member, _mix_sql, image_curves
from tintwell.sources import bridge as B

K = ["image_id", "x", "y"]


@plugins.split_method("gray_key")
def gray_key(pixels, params):
    """A user's method: all darkness in the fourth ink."""
    luma = C.weighted(C.LUMA, tuple(F.col(c) / 255.0 for c in "rgb"))
    zero = F.lit(0.0)
    return pixels.select(*K, zero.alias("c0"), zero.alias("c1"), zero.alias("c2"), (1 - luma).alias("c3"))


_MEANS = ", ".join(f"round(avg(c{k}), 5) AS c{k}" for k in range(4))


@query(
    "k1_split_methods",
    B.ctes("rgb21")
    + f""", {S.fractions_cte('f0', 'rgb21')}, {S.hsl_cte('hs', 'f0')}, f1 AS (SELECT *, least(1 - sr, 1 - sg, 1 - sb) * 0.5 AS k FROM hs), mem AS (SELECT *, {', '.join(f'{_member(r)} AS m{i}' for i, r in enumerate(RANGES))} FROM f1),
al AS (SELECT 'channel' AS method, image_id, {", ".join(f"{S.clamp01(c)} AS c{i}" for i, c in enumerate(_channel_sql('cmyk')[:4]))} FROM f1
  UNION ALL SELECT 'selective', image_id, {S.clamp01('greatest(m0 * sat, m2 * sat)')}, {S.clamp01('m1 * sat')}, 0, {S.clamp01('(1 - greatest(m0, m1, m2)) * (1 - light)')} FROM mem
  UNION ALL SELECT 'gray_key', image_id, 0, 0, 0, 1 - {S.LUMA.format('sr', 'sg', 'sb')} FROM f1)
SELECT method, image_id, {_MEANS} FROM al GROUP BY method, image_id""",
)
def k1_split_methods(spark, folder):
    px = B.rgb21(spark, folder)
    wanted = {"channel": {}, "selective": {"ranges": RANGES, "base": 3}, "gray_key": {}}
    out = None
    for name, params in wanted.items():
        cov = plugins.run_split(name, px, params).select(F.lit(name).alias("method"), "image_id", *COV)
        out = cov if out is None else out.unionByName(cov)
    return out.groupBy("method", "image_id").agg(*[R(F.avg(c), c, 5) for c in COV])


@query("k1_ink_matching")
def k1_ink_matching(spark, folder):
    """Ink matching of whole pixels through its prepared table."""
    cov = plugins.run_split("ink_matching", B.rgb21(spark, folder), {"table": FIXED, "size": plugins.MT.DRAFT})
    return cov.groupBy("image_id").agg(*[R(F.avg(c), c, 5) for c in COV])


@query("k1_detail")
def k1_detail(spark, folder):
    cov = plugins.run_split("detail", B.rgb21(spark, folder), {"sigma": 1.0, "mode": "edges"})
    return cov.groupBy("image_id").agg(*[R(F.avg(c), c, 5) for c in COV])


@plugins.halftone("half")
def half(pts, coverage, params):
    """A user's halftone: ink wherever coverage passes a limit."""
    return coverage.select(*K, "ink", (F.col("c") >= params.get("limit", 0.5)).alias("on"))


@query(
    "k2_halftones",
    ORACLES["h4_am_halftone"].replace("SELECT image_id, x, y, ink, CASE WHEN t <= 0", "SELECT 'am' AS kind, image_id, ink, count(*) AS cells, CAST(sum(CASE WHEN CASE WHEN t <= 0").replace(
        'ELSE rank < t END AS "on" FROM', "ELSE rank < t END THEN 1 ELSE 0 END) AS BIGINT) AS inked FROM"
    )
    + " GROUP BY image_id, ink UNION ALL SELECT 'half', image_id, ink, count(*), CAST(sum(CASE WHEN c >= 0.4 THEN 1 ELSE 0 END) AS BIGINT) FROM cov_long GROUP BY image_id, ink"
    + " UNION ALL SELECT 'carry', image_id, ink, 16, CAST(sum(v) AS BIGINT) FROM (SELECT image_id, ink, y, CAST((2 * sum(CAST(floor(c * 255 + 0.5) AS BIGINT)) + 255) // 510 AS BIGINT) AS v FROM cov_long GROUP BY image_id, ink, y) z GROUP BY image_id, ink",
)
def k2_halftones(spark, folder):
    pts, cov = points(spark, folder), cov_long(spark, folder)
    wanted = {"am": {"scale": 2.0, "width": 4, "height": 4, "max_dot": 0.9, "min_dot": 1.2, "min_dot_mode": "round"}, "half": {"limit": 0.4}, "carry": {}}
    out = None
    for name, params in wanted.items():
        dots = plugins.run_halftone(name, pts, cov, params)
        part = dots.groupBy("image_id", "ink").agg(F.count("*").alias("cells"), F.sum(F.col("on").cast("bigint")).alias("inked")).withColumn("kind", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.select("kind", "image_id", "ink", "cells", "inked")


@query("k2_lattices")
def k2_lattices(spark, folder):
    """Hexagonal and ring screens of the coverage images."""
    pts, cov = points(spark, folder), cov_long(spark, folder)
    out = None
    for name in ("hex", "rings"):
        dots = plugins.run_halftone(name, pts, cov, {"scale": 2.0, "width": 4, "height": 4})
        part = dots.groupBy("image_id", "ink").agg(F.count("*").alias("cells"), F.sum(F.col("on").cast("bigint")).alias("inked")).withColumn("kind", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


_Y = S.LUMA.format("mr", "mg", "mb")


@query(
    "flow_print_preview",
    B.ctes("rgb21")
    + f""", {TONE}, kn AS (SELECT image_id, x, y, c0 * (1 - c3) AS c0, c1 * (1 - c3) AS c1, c2 * (1 - c3) AS c2, c3 FROM toned), tt AS (SELECT *, c0 + c1 + c2 + c3 AS s FROM kn),
lim AS (SELECT image_id, x, y, {", ".join(f"CASE WHEN s > 1.5 THEN c{k} * 1.5::DOUBLE / s ELSE c{k} END AS c{k}" for k in range(4))} FROM tt),
mx AS (SELECT image_id, x, y, {", ".join(f"{_mix_sql(i)} AS m{c}" for i, c in enumerate("rgb"))} FROM lim)
SELECT image_id, x, y, {", ".join(f"round({S.srgb(f'm{c}')}, 5) AS {c}" for c in "rgb")} FROM mx""",
)
def flow_print_preview(spark, folder):
    """Pixels to the colour they print as: tone map, knockout, ink limit, mix, encode."""
    cov = E.tone_map(B.rgb21(spark, folder), image_curves(spark, folder), ["image_id"])
    cov = L.layer_options(cov.select(*K, *COV), None, [False, False, False, True], [0.0] * 4, 1.5)
    r, g, b = M.mix([F.col(c) for c in COV], FIXED)
    mixed = cov.select(*K, r.alias("r"), g.alias("g"), b.alias("b"))
    out = [C.linear_to_srgb(c) for c in C.gamut_compress((F.col("r"), F.col("g"), F.col("b")))]
    return mixed.select(*K, *[R(c, n, 5) for c, n in zip(out, "rgb")])

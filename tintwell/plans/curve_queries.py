"""Point curves and lookup tables over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tintwell.functions import color as C
from tintwell.operators import curves as D
from tintwell.plans import sql as S
from tintwell.plans.registry import query
from tintwell.session import read_table
from tintwell.sources import bridge as B

R = lambda c, n, d=6: F.round(c, d).alias(n)


def byte_at(i: int):
    return B.to_byte(F.get("embedding", F.lit(i)).cast("double"))


def byte_sql(i: int) -> str:
    return f"CAST(least(255, greatest(0, floor(CAST(embedding[{i + 1}] AS DOUBLE) * 256 + 128))) AS INTEGER)"


def vectors(spark, folder):
    return read_table(spark, folder, "embeddings").withColumnRenamed("vec_id", "curve_id")


def norm_ctes(src: str = "curve_points", key: str = "curve_id") -> str:
    return f"""n1 AS (SELECT {key}, {S.clamp01('x')} AS x, arg_max({S.clamp01('y')}, seq) AS y FROM {src} GROUP BY {key}, {S.clamp01('x')}),
n2 AS (SELECT *, lead(x) OVER (PARTITION BY {key} ORDER BY x) AS nx FROM n1),
norm AS (SELECT {key}, x, y, CAST(row_number() OVER (PARTITION BY {key} ORDER BY x) - 1 AS INTEGER) AS j, CAST(count(*) OVER (PARTITION BY {key}) AS INTEGER) AS n FROM n2 WHERE nx IS NULL OR nx - x >= 1e-6)"""


def sample_ctes(size: int, out: str = "samples", src: str = "curve_points", key: str = "curve_id", norm: bool = True) -> str:
    """CTEs ending in `out`(key, i, v); needs WITH RECURSIVE."""
    last = size - 1
    p = out
    return (norm_ctes(src, key) + ",\n" if norm else "") + f"""{p}_d AS (SELECT {key}, j, n, x, y, lead(x) OVER w AS x1, lead(y) OVER w AS y1,
    (lead(y) OVER w - y) / greatest(1e-9, lead(x) OVER w - x) AS d FROM norm WINDOW w AS (PARTITION BY {key} ORDER BY j)),
{p}_m AS (SELECT *, CASE WHEN j = 0 THEN d WHEN j = n - 1 THEN lag(d) OVER w WHEN lag(d) OVER w * d <= 0 THEN 0.0::DOUBLE ELSE (lag(d) OVER w + d) / 2 END AS m0 FROM {p}_d WINDOW w AS (PARTITION BY {key} ORDER BY j)),
{p}_n AS (SELECT *, lead(m0) OVER (PARTITION BY {key} ORDER BY j) AS m0n FROM {p}_m),
{p}_f AS (
  SELECT {key}, j, CASE WHEN n = 1 THEN 0 WHEN d = 0 THEN 0 WHEN pow(m0 / d, 2) + pow(m0n / d, 2) > 9 THEN 3.0::DOUBLE / sqrt((m0 / d) * (m0 / d) + (m0n / d) * (m0n / d)) * (m0 / d) * d ELSE m0 END AS m,
    CASE WHEN d = 0 THEN 0 WHEN (m0 / d) * (m0 / d) + (m0n / d) * (m0n / d) > 9 THEN 3.0::DOUBLE / sqrt((m0 / d) * (m0 / d) + (m0n / d) * (m0n / d)) * (m0n / d) * d ELSE m0n END AS carry FROM {p}_n WHERE j = 0
  UNION ALL
  SELECT q.{key}, q.j, CASE WHEN q.j = q.n - 1 THEN f.carry WHEN q.d = 0 THEN 0 WHEN (f.carry / q.d) * (f.carry / q.d) + (m0n / q.d) * (m0n / q.d) > 9
      THEN 3.0::DOUBLE / sqrt((f.carry / q.d) * (f.carry / q.d) + (m0n / q.d) * (m0n / q.d)) * (f.carry / q.d) * q.d ELSE f.carry END,
    CASE WHEN q.j = q.n - 1 THEN 0 WHEN q.d = 0 THEN 0 WHEN (f.carry / q.d) * (f.carry / q.d) + (m0n / q.d) * (m0n / q.d) > 9
      THEN 3.0::DOUBLE / sqrt((f.carry / q.d) * (f.carry / q.d) + (m0n / q.d) * (m0n / q.d)) * (m0n / q.d) * q.d ELSE m0n END
  FROM {p}_f f JOIN {p}_n q ON q.{key} = f.{key} AND q.j = f.j + 1),
{p}_s AS (SELECT n.{key}, n.x, n.y, n.x1, n.y1, f.m, lead(f.m) OVER (PARTITION BY n.{key} ORDER BY n.j) AS mb, n.j, n.n FROM {p}_n n JOIN {p}_f f ON n.{key} = f.{key} AND n.j = f.j),
{p}_k AS (SELECT CAST(range AS INTEGER) AS i, range / {float(last)}::DOUBLE AS px FROM range({size})),
{p} AS MATERIALIZED (
  SELECT {key}, i, y AS v FROM {p}_s, {p}_k WHERE j = 0 AND px <= x
  UNION ALL SELECT {key}, i, y FROM {p}_s, {p}_k WHERE j = n - 1 AND px > x
  UNION ALL SELECT {key}, i, {S.clamp01("(2 * t * t * t - 3 * t * t + 1) * y + (t * t * t - 2 * t * t + t) * h * m + (-2 * t * t * t + 3 * t * t) * y1 + (t * t * t - t * t) * h * mb")}
  FROM (SELECT *, (px - x) / (x1 - x) AS t, x1 - x AS h FROM {p}_s, {p}_k WHERE j < n - 1 AND px > x AND px <= x1) z)"""


REC = B.ctes("curve_points").replace("WITH ", "WITH RECURSIVE ", 1) + ",\n"


@query("d1_normalize_curve", B.ctes("curve_points") + ", " + norm_ctes() + " SELECT curve_id, x, y FROM norm")
def d1_normalize_curve(spark, folder):
    return D.normalize_curve(B.curve_points(spark, folder), ["curve_id"])


@query("d2_sample_curve", REC + sample_ctes(256) + " SELECT curve_id, i, round(v, 6) AS v FROM samples")
def d2_sample_curve(spark, folder):
    return D.sample_curves(B.curve_points(spark, folder), ["curve_id"], 256).select("curve_id", "i", R("v", "v"))


TONES = f"""tones AS (SELECT vec_id AS curve_id, {byte_sql(17)} / 1275.0::DOUBLE AS black, 1 - {byte_sql(18)} / 1275.0::DOUBLE AS white,
  greatest(-100, least(100, {byte_sql(19)} - 128)) AS mid, vec_id % 3 = 0 AS invert, 0.55::DOUBLE + (vec_id % 4) * 0.43::DOUBLE AS density FROM embeddings)"""


def tones(spark, folder):
    v = vectors(spark, folder)
    return v.select(
        "curve_id",
        (byte_at(17) / 1275.0).alias("black"),
        (1 - byte_at(18) / 1275.0).alias("white"),
        F.greatest(F.lit(-100), F.least(F.lit(100), byte_at(19) - 128)).alias("mid"),
        (F.col("curve_id") % 3 == 0).alias("invert"),
        ((F.col("curve_id") % 4) * 0.43 + 0.55).alias("density"),
    )


def _tone_sql(invert: str, density: str) -> str:
    x = f"CASE WHEN {invert} THEN 1 - i / 255.0::DOUBLE ELSE i / 255.0::DOUBLE END"
    spread = S.clamp01(f"(({x}) - black) / (greatest(black + 1 / 255.0::DOUBLE, white) - black)")
    return (
        REC
        + sample_ctes(1024)
        + f""", {TONES}, e AS (SELECT *, CAST(floor(pow({spread}, 1 / pow(2.0::DOUBLE, mid / 50.0::DOUBLE)) * 1023 + 0.5) AS INTEGER) AS cell FROM tones, (SELECT CAST(range AS INTEGER) AS i FROM range(256)) q)
SELECT e.curve_id, e.i, CAST(floor(least(1.0::DOUBLE, s.v * {density}) * 255 + 0.5) AS INTEGER) AS v FROM e JOIN samples s ON s.curve_id = e.curve_id AND s.i = e.cell"""
    )


@query("d3_levels_lut", _tone_sql("false", "1"))
def d3_levels_lut(spark, folder):
    curves = D.sample_curves(B.curve_points(spark, folder), ["curve_id"], 1024)
    settings = tones(spark, folder).withColumns({"invert": F.lit(False), "density": F.lit(1.0)})
    return D.tone_lut(settings, curves, ["curve_id"])


@query(
    "d4_apply_lut",
    B.ctes("curve_points", "rgb21").replace("WITH ", "WITH RECURSIVE ", 1)
    + ",\n"
    + sample_ctes(256)
    + """, px AS (SELECT image_id, x, y, (r + g + b) / 765.0::DOUBLE AS c FROM rgb21), spot AS MATERIALIZED (SELECT *, c * 255 AS pos, CAST(floor(c * 255) AS INTEGER) AS k FROM px),
pairs AS MATERIALIZED (SELECT *, coalesce(lead(v) OVER (PARTITION BY curve_id ORDER BY i), v) AS w FROM samples)
SELECT image_id, x, y, round(v + (w - v) * (pos - k), 6) AS toned FROM spot JOIN pairs ON curve_id = image_id AND i = k""",
)
def d4_apply_lut(spark, folder):
    lut = D.sample_curves(B.curve_points(spark, folder), ["curve_id"], 256).withColumnRenamed("curve_id", "image_id")
    px = B.rgb21(spark, folder).select("image_id", "x", "y", ((F.col("r") + F.col("g") + F.col("b")) / 765.0).alias("c"))
    return D.apply_lut(px, lut, ["image_id"], "c", "toned").select("image_id", "x", "y", R("toned", "toned"))


@query("d5_ink_tone_lut", _tone_sql("invert", "density"))
def d5_ink_tone_lut(spark, folder):
    curves = D.sample_curves(B.curve_points(spark, folder), ["curve_id"], 1024)
    return D.tone_lut(tones(spark, folder), curves, ["curve_id"])


BANDS = f"""band_sets AS (SELECT vec_id AS set_id, 0.2::DOUBLE + 0.2::DOUBLE * {byte_sql(9)} / 255.0::DOUBLE AS c1, 0.6::DOUBLE + 0.2::DOUBLE * {byte_sql(10)} / 255.0::DOUBLE AS c2,
  0.1::DOUBLE * {byte_sql(11)} / 255.0::DOUBLE AS o1, CASE WHEN vec_id % 7 = 0 THEN 0 ELSE 0.1::DOUBLE * {byte_sql(12)} / 255.0::DOUBLE END AS o2,
  (['hard','linear','smooth'])[CAST(vec_id % 3 AS INTEGER) + 1] AS falloff, CASE WHEN vec_id % 2 = 0 THEN 'flat' ELSE 'gradient' END AS fill, CAST(vec_id % 5 AS INTEGER) AS posterize FROM embeddings),
bands AS (SELECT set_id, band, 3 AS n_bands, (list_value(0.0::DOUBLE, c1, c2))[band + 1] AS lo, (list_value(c1, c2, 1.0::DOUBLE))[band + 1] AS hi,
  (list_value(0.0::DOUBLE, o1, o2))[band + 1] AS overlap_lo, (list_value(o1, o2, 0.0::DOUBLE))[band + 1] AS overlap_hi, falloff, fill, posterize,
  CASE WHEN (set_id + band) % 5 <> 0 AND set_id % 11 <> 3 THEN CAST((set_id + band) % 4 AS INTEGER) END AS ink FROM band_sets, (SELECT CAST(range AS INTEGER) AS band FROM range(3)) q)"""


def bands(spark, folder):
    v = vectors(spark, folder).withColumnRenamed("curve_id", "set_id")
    k = F.col("set_id")
    sets = v.select(
        "set_id",
        (byte_at(9) * 0.2 / 255.0 + 0.2).alias("c1"),
        (byte_at(10) * 0.2 / 255.0 + 0.6).alias("c2"),
        (byte_at(11) * 0.1 / 255.0).alias("o1"),
        F.when(k % 7 == 0, F.lit(0.0)).otherwise(byte_at(12) * 0.1 / 255.0).alias("o2"),
        F.get(F.array(F.lit("hard"), F.lit("linear"), F.lit("smooth")), (k % 3).cast("int")).alias("falloff"),
        F.when(k % 2 == 0, "flat").otherwise("gradient").alias("fill"),
        (k % 5).cast("int").alias("posterize"),
    )
    rows = sets.select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("band"))
    pick = lambda *cols: F.get(F.array(*cols), F.col("band"))
    zero, one = F.lit(0.0), F.lit(1.0)
    return rows.select(
        "set_id",
        "band",
        F.lit(3).alias("n_bands"),
        pick(zero, F.col("c1"), F.col("c2")).alias("lo"),
        pick(F.col("c1"), F.col("c2"), one).alias("hi"),
        pick(zero, F.col("o1"), F.col("o2")).alias("overlap_lo"),
        pick(F.col("o1"), F.col("o2"), zero).alias("overlap_hi"),
        "falloff",
        "fill",
        "posterize",
        F.when(((k + F.col("band")) % 5 != 0) & (k % 11 != 3), ((k + F.col("band")) % 4).cast("int")).alias("ink"),
    )


def _shape_sql(t: str) -> str:
    x = S.clamp01(t)
    return f"(CASE falloff WHEN 'hard' THEN CASE WHEN {x} < 0.5 THEN 0.0::DOUBLE ELSE 1 END WHEN 'linear' THEN {x} ELSE {x} * {x} * (3 - {x} * 2) END)"


BAND_CURVES = f"""band_rows AS (SELECT *, i / 255.0::DOUBLE AS l FROM bands, (SELECT CAST(range AS INTEGER) AS i FROM range(256)) q WHERE ink IS NOT NULL),
band_m AS (SELECT *, CASE WHEN band = 0 THEN 1.0::DOUBLE WHEN overlap_lo > 0 THEN {_shape_sql("(l - (lo - overlap_lo / 2)) / overlap_lo")} WHEN l >= lo THEN 1 ELSE 0 END AS up,
  CASE WHEN band = 2 THEN 1.0::DOUBLE WHEN overlap_hi > 0 THEN 1 - {_shape_sql("(l - (hi - overlap_hi / 2)) / overlap_hi")} WHEN l >= hi THEN 0 ELSE 1 END AS down,
  1 - {S.clamp01("(l - lo) / (hi - lo)")} AS shade FROM band_rows),
band_curves AS (SELECT set_id, ink, i, max(greatest(0.0::DOUBLE, up * down * CASE WHEN fill = 'flat' THEN 1 WHEN posterize > 0 THEN ceil(shade * posterize) / posterize ELSE shade END)) AS v FROM band_m GROUP BY set_id, ink, i)"""


@query("d6_bands_to_curves", f"WITH {BANDS}, {BAND_CURVES} SELECT set_id, ink, i, round(v, 6) AS v FROM band_curves")
def d6_bands_to_curves(spark, folder):
    return D.bands_to_curves(bands(spark, folder), ["set_id"]).select("set_id", "ink", "i", R("v", "v"))


@query(
    "d7_resolve_band_inks",
    B.ctes("palettes")
    + f""", t0 AS (SELECT palette_id, ink, {S.hex_bytes('hex')} FROM palettes), {S.linear_cte('t1', 't0')}, {S.lab_cte('t2', 't1')},
ranked AS (SELECT palette_id, ink, row_number() OVER (PARTITION BY palette_id ORDER BY round(lab_l, 9), ink) - 1 AS rank FROM t2),
b AS (SELECT palette_id, band, 2 + palette_id % 4 AS n_bands, CASE (palette_id + band) % 4 WHEN 2 THEN 'paper' WHEN 3 THEN CAST((palette_id + band) % 6 AS VARCHAR) ELSE 'auto' END AS choice
  FROM (SELECT DISTINCT palette_id FROM palettes) p, (SELECT CAST(range AS INTEGER) AS band FROM range(5)) q WHERE band < 2 + palette_id % 4)
SELECT b.palette_id, b.band, CAST(CASE WHEN choice = 'auto' THEN CASE WHEN n_bands > 4 AND band = n_bands - 1 THEN NULL ELSE r.ink END
  WHEN choice = 'paper' THEN NULL WHEN CAST(choice AS INTEGER) < 4 THEN CAST(choice AS INTEGER) END AS INTEGER) AS ink FROM b LEFT JOIN ranked r ON r.palette_id = b.palette_id AND r.rank = b.band""".replace(
        "WHEN choice = 'paper' THEN NULL WHEN CAST(choice AS INTEGER) < 4 THEN CAST(choice AS INTEGER) END", "WHEN TRY_CAST(choice AS INTEGER) < 4 THEN TRY_CAST(choice AS INTEGER) END"
    ),
)
def d7_resolve_band_inks(spark, folder):
    p = B.palettes(spark, folder)
    l = C.rgb_to_lab(C.hex_to_rgb(F.col("hex")))[0]
    inks = p.select("palette_id", "ink", F.round(l, 9).alias("l"))
    one = p.where(F.col("ink") == 0).select("palette_id", (F.col("palette_id") % 4 + 2).cast("int").alias("n_bands"))
    rows = one.select("*", F.explode(F.sequence(F.lit(0), F.col("n_bands") - 1)).alias("band"))
    k = F.col("palette_id") + F.col("band")
    rows = rows.withColumn("choice", F.when(k % 4 == 2, "paper").when(k % 4 == 3, (k % 6).cast("string")).otherwise("auto"))
    return D.resolve_band_inks(inks, rows, ["palette_id"]).select("palette_id", "band", "ink")


_PRESET_VALUES = ", ".join(f"('{name}', {i}, {float(x)}::DOUBLE, {float(y)}::DOUBLE)" for name, pts in D.PRESETS.items() for i, (x, y) in enumerate(pts))


@query(
    "d8_point_curves",
    B.ctes("palettes").replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", preset_points(preset, seq, x, y) AS (VALUES {_PRESET_VALUES}), {sample_ctes(256, src='preset_points', key='preset')},
area AS (SELECT preset, sum(v) AS area, max(CASE WHEN i = 100 THEN v END) AS v100 FROM samples GROUP BY preset),
asked AS (SELECT palette_id, ink, (['shadow','midtone','highlight','full','off'])[CAST((palette_id + ink) % 5 AS INTEGER) + 1] AS preset FROM palettes)
SELECT palette_id, ink, preset, round(area, 6) AS area, round(v100, 6) AS v100 FROM asked JOIN area USING (preset)""",
)
def d8_point_curves(spark, folder):
    names = F.array(*[F.lit(n) for n in D.PRESETS])
    asked = B.palettes(spark, folder).select("palette_id", "ink", F.get(names, ((F.col("palette_id") + F.col("ink")) % 5).cast("int")).alias("preset"))
    # Each preset is sampled once, however many inks ask for it.
    points = D.preset_points(asked.select("preset").distinct(), "preset")
    samples = D.sample_curves(points, ["preset"], 256)
    area = samples.groupBy("preset").agg(F.sum("v").alias("area"), F.max(F.when(F.col("i") == 100, F.col("v"))).alias("v100"))
    return asked.join(area, "preset").select("palette_id", "ink", "preset", R("area", "area"), R("v100", "v100"))


_OFF = "abs(lst[k + 1] - (lst[a + 1] + (k / 255.0::DOUBLE - a / 255.0::DOUBLE) / (b / 255.0::DOUBLE - a / 255.0::DOUBLE) * (lst[b + 1] - lst[a + 1])))"


@query(
    "d9_simplify_curves",
    REC
    + sample_ctes(256)
    + f""", lists AS (SELECT curve_id, list(v ORDER BY i) AS lst FROM samples GROUP BY curve_id),
seg AS (SELECT curve_id, lst, 0 AS a, 255 AS b FROM lists
  UNION ALL SELECT curve_id, lst, CASE WHEN side = 0 THEN a ELSE cut END, CASE WHEN side = 0 THEN cut ELSE b END
  FROM (SELECT curve_id, lst, a, b, CAST(-(list_reverse_sort(list_transform(list_filter(range(a + 1, b), lambda k: {_OFF} > 0.01), lambda k: {{'d': round({_OFF}, 9), 'k': -k}}))[1]).k AS INTEGER) AS cut FROM seg) s,
    (VALUES (0), (1)) sides(side) WHERE cut IS NOT NULL),
kept AS (SELECT DISTINCT curve_id, a AS i FROM seg UNION SELECT DISTINCT curve_id, b FROM seg)
SELECT kept.curve_id, kept.i, floor(kept.i / 255.0::DOUBLE * 1000 + 0.5) / 1000.0::DOUBLE AS x, floor(v * 1000 + 0.5) / 1000.0::DOUBLE AS y FROM kept JOIN samples USING (curve_id, i)""",
)
def d9_simplify_curves(spark, folder):
    lut = D.sample_curves(B.curve_points(spark, folder), ["curve_id"], 256)
    return D.simplify_curves(lut, ["curve_id"])


@query(
    "d10_move_linked",
    B.ctes("curve_points")
    + f""", {norm_ctes()}, edits AS (SELECT vec_id AS curve_id, {byte_sql(21)} / 255.0::DOUBLE AS from_x, ({byte_sql(22)} - 128) / 1000.0::DOUBLE AS dx, ({byte_sql(23)} - 128) / 500.0::DOUBLE AS dy,
  CASE vec_id % 5 WHEN 0 THEN 'first' WHEN 1 THEN 'last' END AS endpoint FROM embeddings),
hit AS (SELECT e.curve_id, CASE endpoint WHEN 'first' THEN 0 WHEN 'last' THEN n - 1 ELSE j END AS j FROM edits e JOIN norm USING (curve_id)
  WHERE endpoint IS NOT NULL OR (j > 0 AND j < n - 1) QUALIFY row_number() OVER (PARTITION BY e.curve_id ORDER BY abs(x - from_x), j) = 1),
w AS (SELECT norm.*, lag(x) OVER v AS lx, lead(x) OVER v AS rx FROM norm WINDOW v AS (PARTITION BY curve_id ORDER BY j))
SELECT w.curve_id, w.j AS i, CASE WHEN hit.j IS NULL OR endpoint IS NOT NULL THEN x ELSE least(rx - 0.01, greatest(lx + 0.01, x + dx)) END AS x,
  CASE WHEN hit.j IS NULL THEN y ELSE {S.clamp01('y + dy')} END AS y FROM w JOIN edits USING (curve_id) LEFT JOIN hit ON hit.curve_id = w.curve_id AND hit.j = w.j""",
)
def d10_move_linked(spark, folder):
    v = vectors(spark, folder)
    edits = v.select(
        "curve_id",
        (byte_at(21) / 255.0).alias("from_x"),
        ((byte_at(22) - 128) / 1000.0).alias("dx"),
        ((byte_at(23) - 128) / 500.0).alias("dy"),
        F.when(F.col("curve_id") % 5 == 0, "first").when(F.col("curve_id") % 5 == 1, "last").alias("endpoint"),
    )
    flat = D.normalize_curve(B.curve_points(spark, folder), ["curve_id"])
    numbered = flat.withColumn("i", F.row_number().over(Window.partitionBy("curve_id").orderBy("x")) - 1)
    return D.move_linked(numbered, edits, ["curve_id"])


@query(
    "d11_invert_lut",
    REC
    + sample_ctes(65)
    + f""", t AS (SELECT CAST(range AS INTEGER) AS t, range / 255.0::DOUBLE AS target FROM range(256)),
first AS (SELECT c.curve_id, t.t, t.target, coalesce((SELECT min(s.i) - 1 FROM samples s WHERE s.curve_id = c.curve_id AND s.i >= 1 AND s.v >= t.target), 64) AS k FROM (SELECT DISTINCT curve_id FROM samples) c, t)
SELECT f.curve_id, f.t AS i, round(least(1.0::DOUBLE, (k + CASE WHEN b.v > a.v THEN {S.clamp01('(target - a.v) / (b.v - a.v)')} ELSE 0 END) / 64.0::DOUBLE), 6) AS v
FROM first f JOIN samples a ON a.curve_id = f.curve_id AND a.i = k JOIN samples b ON b.curve_id = f.curve_id AND b.i = least(64, k + 1)""",
)
def d11_invert_lut(spark, folder):
    lut = D.sample_curves(B.curve_points(spark, folder), ["curve_id"], 65)
    return D.invert_lut(lut, ["curve_id"], 64).select("curve_id", "i", R("v", "v"))

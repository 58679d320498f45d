"""Palettes, clustering and ink matching over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tintwell.functions import color as C
from tintwell.operators import halftone as H
from tintwell.operators import match as MT
from tintwell.operators import palette as P
from tintwell.plans import sql as S
from tintwell.plans.curve_queries import R
from tintwell.plans.halftone_queries import DITHER, OFFSETS, cov_long
from tintwell.plans.registry import query
from tintwell.plans.spatial_queries import tiles, vec_images
from tintwell.plans.split_queries import FIXED
from tintwell.sources import bridge as B

LAB = ["l", "a", "b"]


@query(
    "i1_histogram",
    B.ctes("flat_px")
    + f""", {S.fractions_cte('t', 'flat_px')} SELECT image_id, CAST(floor({S.clamp01('(sr * 0.2126 + sg * 0.7152 + sb * 0.0722)')} * 255 + 0.5) AS INTEGER) AS bin, count(*) AS n FROM t GROUP BY 1, 2""",
)
def i1_histogram(spark, folder):
    return P.histogram(B.flat_px(spark, folder), ["image_id"])


@query(
    "i2_sample_lab",
    B.ctes("rgb21")
    + f""", {S.linear_cte('t', 'rgb21')}, o AS (SELECT CAST(range AS INTEGER) AS o FROM range(4)),
w AS (SELECT image_id, a.o AS x, b.o AS y, t.lr, t.lg, t.lb, CASE WHEN (image_id + t.x) % 3 = 0 THEN 0 ELSE 255 END AS al,
  greatest(0, least((t.x + 1) * 4 / 7.0::DOUBLE, a.o + 1) - greatest(t.x * 4 / 7.0::DOUBLE, a.o)) * greatest(0, least((t.y + 1) * 2 / 3.0::DOUBLE, b.o + 1) - greatest(t.y * 2 / 3.0::DOUBLE, b.o)) AS w FROM t, o a, o b WHERE b.o < 2),
m AS (SELECT image_id, x, y, sum(lr * w) / sum(w) AS mr, sum(lg * w) / sum(w) AS mg, sum(lb * w) / sum(w) AS mb, sum(al * w) / sum(w) AS al FROM w WHERE w > 1e-12 GROUP BY 1, 2, 3),
q AS (SELECT image_id, x, y, {S.byte('mr')} AS r, {S.byte('mg')} AS g, {S.byte('mb')} AS b FROM m WHERE al >= 128), {S.linear_cte('q1', 'q')}, {S.lab_cte('q2', 'q1')}
SELECT image_id, x, y, round(lab_l, 5) AS l, round(lab_a, 5) AS a, round(lab_b, 5) AS b FROM q2""",
)
def i2_sample_lab(spark, folder):
    px = B.rgb21(spark, folder).withColumn("alpha", F.when((F.col("image_id") + F.col("x")) % 3 == 0, 0).otherwise(255))
    out = P.sample_lab(px, vec_images(spark, folder, 7, 3), edge=4)
    return out.select("image_id", "x", "y", *[R(c, c, 5) for c in LAB])


LAB21 = f"""{S.linear_cte('z0', 'rgb21')}, {S.lab_cte('z1', 'z0')}, lab21 AS (SELECT image_id, y * 7 + x AS pid, lab_l AS l, lab_a AS a, lab_b AS b FROM z1)"""
CENTERS = "centers AS (SELECT image_id, CAST(pid // 5 AS INTEGER) AS cluster, l, a, b FROM lab21 WHERE pid % 5 = 0 AND pid < 20)"


def lab21(spark, folder):
    l, a, b = C.rgb_to_lab((F.col("r"), F.col("g"), F.col("b")))
    return B.rgb21(spark, folder).select("image_id", (F.col("y") * 7 + F.col("x")).alias("pid"), l.alias("l"), a.alias("a"), b.alias("b"))


def centers21(spark, folder):
    rows = lab21(spark, folder).where((F.col("pid") % 5 == 0) & (F.col("pid") < 20))
    return rows.select("image_id", F.floor(F.col("pid") / 5).cast("int").alias("cluster"), (F.col("pid") == 0).alias("fixed"), *LAB)


def _round_sql(k: int, centers: str) -> str:
    return f"""as{k} AS (SELECT p.image_id, p.pid, p.l, p.a, p.b, c.cluster, pow(p.l - c.l, 2) + pow(p.a - c.a, 2) + pow(p.b - c.b, 2) AS d2 FROM lab21 p JOIN {centers} c USING (image_id) QUALIFY row_number() OVER (PARTITION BY p.image_id, p.pid ORDER BY round(d2, 9), c.cluster) = 1),
mn{k} AS (SELECT image_id, cluster, avg(l) AS l, avg(a) AS a, avg(b) AS b FROM as{k} GROUP BY 1, 2),
ce{k} AS (SELECT c.image_id, c.cluster, CASE WHEN c.cluster = 0 THEN c.l ELSE coalesce(m.l, c.l) END AS l, CASE WHEN c.cluster = 0 THEN c.a ELSE coalesce(m.a, c.a) END AS a, CASE WHEN c.cluster = 0 THEN c.b ELSE coalesce(m.b, c.b) END AS b FROM {centers} c LEFT JOIN mn{k} m USING (image_id, cluster))"""


def _settled_sql() -> str:
    """Rounds of the stopping rule, an image a row: once no free centre of any image moves by more than 0.01, centres stay."""
    d2 = lambda p, c: f"(pow({p}.l - {c}.l, 2) + pow({p}.a - {c}.a, 2) + pow({p}.b - {c}.b, 2))"
    away = f"list_transform(c, lambda x: round({d2('p', 'x')}, 9))"
    own = f"list_transform(pts, lambda p: list_position({away}, list_min({away})))"
    mean = lambda n: f"list_avg(list_transform(list_filter(list_zip(pts, own), lambda z: z[2] = j), lambda z: z[1].{n}))"
    new = f"list_transform(range(1, 5), lambda j: CASE WHEN j = 1 OR NOT list_contains(own, j) THEN c[j] ELSE {{'l': {mean('l')}, 'a': {mean('a')}, 'b': {mean('b')}}} END)"
    return f"""per AS (SELECT image_id, list({{'l': l, 'a': a, 'b': b}} ORDER BY pid) AS pts FROM lab21 GROUP BY image_id),
cen AS (SELECT image_id, list({{'l': l, 'a': a, 'b': b}} ORDER BY cluster) AS c FROM centers GROUP BY image_id),
rec AS (SELECT image_id, 0 AS k, pts, c, false AS done FROM per JOIN cen USING (image_id)
  UNION ALL SELECT image_id, k + 1, pts, new, max(list_max(list_transform(range(1, 5), lambda j: {d2('new[j]', 'c[j]')}))) OVER () <= 1e-4::DOUBLE
  FROM (SELECT *, {new} AS new FROM (SELECT *, {own} AS own FROM rec WHERE NOT done AND k < {P.ITERATIONS}) o) n),
fin AS (SELECT image_id, arg_max(c, k) AS c, arg_max(pts, k) AS pts FROM rec GROUP BY image_id),
settled AS (SELECT image_id, j AS cluster, c[j + 1] AS m, list_sum(list_transform(pts, lambda p: list_min({away}))) AS error FROM fin, (SELECT CAST(range AS INTEGER) AS j FROM range(4)) r)"""


SETTLED = B.ctes("rgb21").replace("WITH ", "WITH RECURSIVE ", 1) + f", {LAB21}, {CENTERS}, {_settled_sql()} SELECT image_id, cluster, round(m.l, 5) AS l, round(m.a, 5) AS a, round(m.b, 5) AS b"


@query("i3_kmeans", SETTLED + " FROM settled")
def i3_kmeans(spark, folder):
    """From given centres, one of them pinned, until none moves."""
    out = P.kmeans(lab21(spark, folder), centers21(spark, folder), ["image_id"])
    return out.select("image_id", "cluster", *[R(c, c, 5) for c in LAB])


@query("i3_kmeans_restarts", SETTLED + ", round(error, 3) AS error FROM settled")
def i3_kmeans_restarts(spark, folder):
    """Two equal restarts side by side, of which the second is told, with the total squared distance to its centres."""
    points, centers = lab21(spark, folder), centers21(spark, folder)
    both = centers.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("restart"))
    settled = P.kmeans_runs(points, both, ["image_id"], 2)
    near = P.nearest_runs(points, settled, ["image_id"], 2).groupBy("image_id").agg(F.sum("_d1").alias("error"))
    return settled.where("restart = 1").join(near, "image_id").select("image_id", "cluster", *[R(c, c, 5) for c in LAB], R("error", "error", 3))


@query(
    "i4_weighted_pick",
    B.ctes("gray8") + ", r AS (SELECT image_id, p, sum(g) OVER (PARTITION BY image_id ORDER BY p) AS run, sum(g) OVER (PARTITION BY image_id) AS total FROM gray8) SELECT image_id, min(p) AS p FROM r WHERE run >= 0.37::DOUBLE * total GROUP BY image_id",
)
def i4_weighted_pick(spark, folder):
    return P.weighted_pick(B.gray8(spark, folder).select("image_id", "p", "g"), ["image_id"], "p", "g", F.lit(0.37), block=16)


_PAPER_D = "round(pow(l - 95.9::DOUBLE, 2) + pow(a, 2) + pow(b - 3.6::DOUBLE, 2), 9)"


@query(
    "i5_top_share",
    B.ctes("rgb21")
    + f""", {LAB21}, g AS (SELECT *, image_id % 10 AS grp, image_id * 21 + pid AS gid FROM lab21), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY {_PAPER_D} DESC, gid) AS rn, count(*) OVER (PARTITION BY grp) AS n FROM g)
SELECT grp, round(avg(l), 6) AS l, round(avg(a), 6) AS a, round(avg(b), 6) AS b FROM r WHERE rn <= greatest(1, floor(n * 0.3::DOUBLE + 0.5)) GROUP BY grp""",
)
def i5_top_share(spark, folder):
    members = lab21(spark, folder).select((F.col("image_id") % 10).alias("grp"), (F.col("image_id") * 21 + F.col("pid")).alias("pid"), *LAB)
    key = F.round(C.distance2(P.lab_of(), (F.lit(95.9), F.lit(0.0), F.lit(3.6))), 9)
    return P.top_share_avg(members, ["grp"], key).select("grp", *[R(c, c) for c in LAB])


@query(
    "i6_cluster_share",
    B.ctes("rgb21")
    + f""", {LAB21}, {CENTERS}, {_round_sql(1, 'centers')}, pap AS (SELECT image_id, cluster AS paper FROM centers QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY l DESC, cluster) = 1),
cn AS (SELECT image_id, cluster, count(*) AS n FROM as1 GROUP BY 1, 2)
SELECT image_id, cluster, n, round(CASE WHEN cluster <> paper THEN n / greatest(1, sum(CASE WHEN cluster <> paper THEN n ELSE 0 END) OVER (PARTITION BY image_id))::DOUBLE END, 6) AS share, cluster = paper AS is_paper FROM cn JOIN pap USING (image_id)""",
)
def i6_cluster_share(spark, folder):
    centers = centers21(spark, folder)
    assigned = P.nearest_center(lab21(spark, folder), centers, ["image_id"])
    return P.cluster_share(assigned, centers, ["image_id"], False).select("image_id", "cluster", "n", R("share", "share"), "is_paper")


@query(
    "i7_colorful",
    B.ctes("rgb21")
    + f""", {LAB21}, g AS (SELECT *, image_id % 10 AS grp, image_id * 21 + pid AS gid, sqrt(a * a + b * b) AS ch FROM lab21),
n AS (SELECT grp, floor(count(*) * 0.6::DOUBLE) AS k FROM g GROUP BY grp), c AS (SELECT g.grp, greatest(12, ch) AS cut FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ch) - 1 AS rn FROM g) g JOIN n ON n.grp = g.grp AND g.rn = n.k),
kept AS (SELECT g.* FROM g JOIN c USING (grp) WHERE ch >= cut) SELECT grp, gid AS pid, round(l * 0.5, 6) AS l, round(a, 6) AS a, round(b, 6) AS b FROM kept QUALIFY count(*) OVER (PARTITION BY grp) >= 20""",
)
def i7_colorful(spark, folder):
    pts = lab21(spark, folder).select((F.col("image_id") % 10).alias("grp"), (F.col("image_id") * 21 + F.col("pid")).alias("pid"), *LAB)
    return P.colorful(pts, ["grp"]).select("grp", "pid", *[R(c, c) for c in LAB])


INKS = f"h0 AS (SELECT palette_id, ink, {S.hex_bytes('hex')} FROM palettes), {S.linear_cte('h1', 'h0')}, {S.lab_cte('h2', 'h1')}, inks AS (SELECT palette_id, ink AS id, round(lab_l, 9) AS l, round(lab_a, 9) AS a, round(lab_b, 9) AS b, (1 + (palette_id * 3 + ink * 7) % 40) / 100.0::DOUBLE AS share FROM h2)"


def inks(spark, folder):
    l, a, b = C.rgb_to_lab(C.hex_to_rgb(F.col("hex")))
    p = B.palettes(spark, folder)
    share = ((F.col("palette_id") * 3 + F.col("ink") * 7) % 40 + 1) / 100.0
    return p.select("palette_id", F.col("ink").alias("id"), *[F.round(c, 9).alias(n) for c, n in zip((l, a, b), LAB)], share.alias("share"))


def _d2(p: str, q: str) -> str:
    return f"(pow({p}.l - {q}.l, 2) + pow({p}.a - {q}.a, 2) + pow({p}.b - {q}.b, 2))"


@query(
    "i8_dedupe_near",
    B.ctes("palettes")
    + f""", {INKS}, f AS (SELECT * FROM inks WHERE id < 2), s AS (SELECT * FROM inks s WHERE id >= 2 AND NOT EXISTS (SELECT 1 FROM f WHERE f.palette_id = s.palette_id AND {_d2('f', 's')} < 1600)),
k AS (SELECT * FROM s WHERE id = 2 OR NOT EXISTS (SELECT 1 FROM s q WHERE q.palette_id = s.palette_id AND q.id = 2 AND {_d2('q', 's')} < 1600))
SELECT palette_id, id, round(l, 6) AS l FROM f UNION ALL SELECT palette_id, id, round(l, 6) FROM k""",
)
def i8_dedupe_near(spark, folder):
    df = inks(spark, folder)
    out = P.dedupe_near(df.where(F.col("id") < 2), df.where(F.col("id") >= 2), ["palette_id"], 40.0)
    return out.select("palette_id", "id", R("l", "l"))


@query(
    "i9_combinations",
    B.ctes("palettes")
    + ", c AS (SELECT a.palette_id, a.ink AS i, b.ink AS j, c.ink AS k FROM palettes a JOIN palettes b USING (palette_id) JOIN palettes c USING (palette_id) WHERE a.ink < b.ink AND b.ink < c.ink) SELECT palette_id, i || '-' || j || '-' || k AS ids FROM c",
)
def i9_combinations(spark, folder):
    sets = P.combinations(inks(spark, folder), ["palette_id"], 3)
    return sets.select("palette_id", F.array_join(F.transform("ids", lambda i: i.cast("string")), "-").alias("ids"))


def _score_sql(style: str, names: list[str]) -> str:
    pairs = [(p, q) for i, p in enumerate(names) for q in names[i + 1 :]]
    ch = lambda p: f"sqrt({p}.a * {p}.a + {p}.b * {p}.b)"
    de = lambda p, q: f"sqrt({_d2(p, q)})"
    hue = lambda p, q: f"(abs(atan2({p}.b, {p}.a) - atan2({q}.b, {q}.a)) * (180 / pi()))"
    if style == "balanced":
        s = "(" + " + ".join(f"{p}.share" for p in names) + ")"
    elif style == "vibrant":
        s = "(" + " + ".join(f"pow({ch(p)}, 1.5) * pow({p}.share, 0.25) * least(1, {p}.share / 0.01::DOUBLE)" for p in names) + ")"
    else:
        ds = [de(p, q) for p, q in pairs]
        low = f"least({', '.join(ds)})" if len(ds) > 1 else ds[0]
        s = f"({low} + ({' + '.join(ds)}) / {float(len(ds))}::DOUBLE * 0.25)" + "".join(f" * least(1, {p}.share / 0.02::DOUBLE)" for p in names)
    for p, q in pairs:
        more = f"WHEN {ch(p)} > 15 AND {ch(q)} > 15 AND (CASE WHEN {hue(p, q)} > 180 THEN 360 - {hue(p, q)} ELSE {hue(p, q)} END) < 30 THEN 0.5" if style == "vibrant" else ""
        s += f" * (CASE WHEN {de(p, q)} < 12 THEN 0.3 {more} ELSE 1 END)::DOUBLE"
    return s


@query(
    "i10_score_sets",
    B.ctes("palettes")
    + f""", {INKS} SELECT x.palette_id, x.id || '-' || y.id || '-' || z.id AS ids, {", ".join(f"round({_score_sql(s, ['x', 'y', 'z'])}, 4) AS {s}" for s in ("balanced", "vibrant", "contrast"))}
FROM inks x JOIN inks y ON y.palette_id = x.palette_id AND y.id > x.id JOIN inks z ON z.palette_id = x.palette_id AND z.id > y.id""",
)
def i10_score_sets(spark, folder):
    sets = P.combinations(inks(spark, folder), ["palette_id"], 3)
    for style in ("balanced", "vibrant", "contrast"):
        sets = P.score_sets(sets, ["palette_id"], style, 3).withColumn(style, F.round("score", 4)).drop("score")
    return sets.select("palette_id", F.array_join(F.transform("ids", lambda i: i.cast("string")), "-").alias("ids"), "balanced", "vibrant", "contrast")


_NEAR12 = "pow(k.l1 - s.l1, 2) + pow(k.a1 - s.a1, 2) + pow(k.b1 - s.b1, 2) < 144 AND pow(k.l2 - s.l2, 2) + pow(k.a2 - s.a2, 2) + pow(k.b2 - s.b2, 2) < 144"


@query(
    "i11_rank_palettes",
    B.ctes("palettes").replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", {INKS},
sets AS (SELECT palette_id, CAST(row_number() OVER (PARTITION BY palette_id ORDER BY round(score, 9) DESC, i, j) AS INTEGER) AS rn, {{'l1': hl, 'a1': ha, 'b1': hb, 'l2': ll, 'a2': la, 'b2': lb}} AS s FROM
  (SELECT *, CASE WHEN xl >= yl THEN xl ELSE yl END AS hl, CASE WHEN xl >= yl THEN xa ELSE ya END AS ha, CASE WHEN xl >= yl THEN xb ELSE yb END AS hb, CASE WHEN xl >= yl THEN yl ELSE xl END AS ll, CASE WHEN xl >= yl THEN ya ELSE xa END AS la, CASE WHEN xl >= yl THEN yb ELSE xb END AS lb FROM
    (SELECT x.palette_id, {_score_sql('contrast', ['x', 'y'])} AS score, x.id AS i, y.id AS j, x.l AS xl, x.a AS xa, x.b AS xb, y.l AS yl, y.a AS ya, y.b AS yb
      FROM (SELECT palette_id, l, a / 8 AS a, b / 8 AS b, id, share FROM inks) x JOIN (SELECT palette_id, l, a / 8 AS a, b / 8 AS b, id, share FROM inks) y ON y.palette_id = x.palette_id AND y.id > x.id) e) f),
fold AS (SELECT palette_id, rn, [s] AS kept FROM sets WHERE rn = 1
  UNION ALL SELECT f.palette_id, s.rn, CASE WHEN len(list_filter(f.kept, lambda k: {_NEAR12.replace('s.', 's.s.')})) > 0 THEN f.kept ELSE list_append(f.kept, s.s) END FROM fold f JOIN sets s ON s.palette_id = f.palette_id AND s.rn = f.rn + 1)
SELECT palette_id, len(kept) AS n, round(kept[1].l1, 5) AS first_l, round(kept[len(kept)].l2, 5) AS last_l, round(kept[CAST(1 + palette_id % len(kept) AS INTEGER)].a1, 5) AS variant_a FROM fold WHERE rn = 6""",
)
def i11_rank_palettes(spark, folder):
    df = inks(spark, folder).withColumns({"a": F.col("a") / 8, "b": F.col("b") / 8})
    scored = P.score_sets(P.combinations(df, ["palette_id"], 2), ["palette_id"], "contrast", 2).withColumn("score", F.round("score", 9))
    ranked = P.rank_palettes(scored, ["palette_id"])
    p, n = F.col("palettes"), F.size("palettes")
    variant = F.get(F.get(p, F.pmod(F.col("palette_id"), n).cast("int")), F.lit(0))["a"]
    return ranked.select(
        "palette_id", n.cast("bigint").alias("n"), R(F.get(F.get(p, F.lit(0)), F.lit(0))["l"], "first_l", 5), R(F.element_at(F.element_at(p, -1), -1)["l"], "last_l", 5), R(variant, "variant_a", 5)
    )


@query("i12_auto_palette")
def i12_auto_palette(spark, folder):
    """Balanced palette of every image: three inks on a kept paper."""
    out = P.auto_palette(lab21(spark, folder), ["image_id"], 3, "#f6f3ec")
    return out.select("image_id", F.array_join("inks", " ").alias("inks"), "paper")


def _auto(style: str, vividness: float = 0.0, variant: int = 0):
    def run(spark, folder):
        out = P.auto_palette(lab21(spark, folder), ["image_id"], 3, "#f6f3ec", style, vividness, variant)
        return out.select("image_id", F.array_join("inks", " ").alias("inks"), "paper")

    return run


query("i12_auto_vibrant")(_auto("vibrant", 0.2))


def _choice_sql(style: str, variant: int) -> str:
    """Eight candidates of two neighbouring palettes; sets of three by score, near copies of better ones left out, 24 at most."""
    near = " AND ".join(f"pow(k[{i}].l - s.inks[{i}].l, 2) + pow(k[{i}].a - s.inks[{i}].a, 2) + pow(k[{i}].b - s.inks[{i}].b, 2) < 144" for i in (1, 2, 3))
    lab = lambda p: f"{{'l': {p}.l, 'a': {p}.a, 'b': {p}.b}}"
    start = "[list_reverse_sort([" + ", ".join(lab(p) for p in "xyz") + "])]" if style == "balanced" else "[]::STRUCT(l DOUBLE, a DOUBLE, b DOUBLE)[][]"
    return B.ctes("palettes").replace("WITH ", "WITH RECURSIVE ", 1) + f""", {INKS}, cand AS (SELECT palette_id // 2 AS grp, palette_id % 2 * 4 + id AS id, share, l, a, b FROM inks),
sets AS (SELECT x.grp, row_number() OVER (PARTITION BY x.grp ORDER BY round({_score_sql(style, ['x', 'y', 'z'])}, 9) DESC, x.id, y.id, z.id) AS rn, list_reverse_sort([{lab('x')}, {lab('y')}, {lab('z')}]) AS inks
  FROM cand x JOIN cand y ON y.grp = x.grp AND y.id > x.id JOIN cand z ON z.grp = x.grp AND z.id > y.id),
begun AS (SELECT x.grp, {start} AS kept FROM cand x JOIN cand y ON y.grp = x.grp AND y.id = 1 JOIN cand z ON z.grp = x.grp AND z.id = 2 WHERE x.id = 0),
fold AS (SELECT grp, 0::BIGINT AS rn, kept FROM begun
  UNION ALL SELECT f.grp, s.rn, CASE WHEN len(f.kept) >= 24 OR len(list_filter(f.kept, lambda k: {near})) > 0 THEN f.kept ELSE list_append(f.kept, s.inks) END FROM fold f JOIN sets s ON s.grp = f.grp AND s.rn = f.rn + 1),
last AS (SELECT grp, arg_max(kept, rn) AS kept FROM fold GROUP BY grp),
pick AS (SELECT grp, kept[CAST(1 + {variant} % len(kept) AS INTEGER)] AS p FROM last)
SELECT grp, {', '.join(f"round(p[{i + 1}].{c}, 5) AS {c}{i}" for i in range(3) for c in LAB)} FROM pick"""


def _choice(style: str, variant: int):
    def run(spark, folder):
        grp = F.floor(F.col("palette_id") / 2).cast("bigint").alias("grp")
        rows = inks(spark, folder).select(grp, (F.col("palette_id") % 2 * 4 + F.col("id")).alias("id"), "share", *LAB)
        lead = rows.where(F.col("id") < 3).groupBy("grp").agg(F.reverse(F.array_sort(F.collect_list(F.struct(*LAB)))).alias("inks"))
        # An odd last palette stands alone.
        found = P.choose_palette(rows, ["grp"], 3, style, variant, lead if style == "balanced" else None)
        return found.select("grp", *[R(F.get("inks", F.lit(i))[c], f"{c}{i}", 5) for i in range(3) for c in LAB])

    return run


#: The ranking of every style; variants past the 24th palette start again.
for _style, _variant in (("balanced", 3), ("vibrant", 0), ("contrast", 25)):
    query(f"i12_choice_{_style}", _choice_sql(_style, _variant))(_choice(_style, _variant))


_NEW = ", ".join(f"({i}, '{h}')" for i, h in enumerate(P.NEW_INKS))


@query(
    "i13_next_ink",
    B.ctes("palettes")
    + f""", n(k, hex) AS (VALUES {_NEW}), u AS (SELECT palette_id, n.hex FROM palettes JOIN n ON k = (palette_id * (ink + 1)) % 7)
SELECT p.palette_id, arg_min(n.hex, n.k) AS hex FROM (SELECT DISTINCT palette_id FROM palettes) p, n WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.palette_id = p.palette_id AND u.hex = n.hex) GROUP BY 1""",
)
def i13_next_ink(spark, folder):
    offered = F.array(*[F.lit(h) for h in P.NEW_INKS])
    used = B.palettes(spark, folder).select("palette_id", F.get(offered, ((F.col("palette_id") * (F.col("ink") + 1)) % 7).cast("int")).alias("hex"))
    return P.next_ink(used, ["palette_id"])


@query(
    "i14_tone_error",
    B.ctes("gray8", "cov16") + f", {DITHER} SELECT image_id, ink, round(avg(CASE WHEN lit THEN 1.0::DOUBLE ELSE 0 END), 6) AS inked, round(avg(c), 6) AS wanted, round(avg(CASE WHEN lit THEN 1.0::DOUBLE ELSE 0 END) - avg(c), 6) AS error FROM dith GROUP BY 1, 2",
)
def i14_tone_error(spark, folder):
    cov = cov_long(spark, folder)
    dots = H.ordered_dither(cov, tiles(spark, folder), ["image_id"], 8, 0.05, 0.95, OFFSETS)
    return P.tone_error(dots, cov, ["image_id", "ink"]).select("image_id", "ink", R("inked", "inked"), R("wanted", "wanted"), R("error", "error"))


# ---- ink matching ----

OPTS = MT.MatchOptions(priority=(0.2, 0.5, 0.7, 0.9), sparsity=0.4, balance=0.3)
_LO, _HI = MT.reachable(FIXED)
TARGET = f"""tg0 AS (SELECT *, lr * {FIXED[0][0]!r}::DOUBLE AS lr2, lg * {FIXED[0][1]!r}::DOUBLE AS lg2, lb * {FIXED[0][2]!r}::DOUBLE AS lb2 FROM colors), tg1 AS (SELECT * EXCLUDE (lr, lg, lb, lr2, lg2, lb2), lr2 AS lr, lg2 AS lg, lb2 AS lb FROM tg0),
{S.lab_cte('tg2', 'tg1')}, target AS (SELECT r, g, b, {_LO!r}::DOUBLE + lab_l / {_HI!r}::DOUBLE * {_HI - _LO!r}::DOUBLE AS tl, lab_a AS ta, lab_b AS tb FROM tg2)"""
COLORS = f"q16 AS (SELECT DISTINCT r, g, b FROM rgb21), {S.linear_cte('colors', 'q16')}"


def colors(spark, folder):
    return B.rgb21(spark, folder).select("r", "g", "b").distinct()


def target():
    return MT.match_target(C.rgb_to_linear((F.col("r"), F.col("g"), F.col("b"))), FIXED, True)


def _cand_sql() -> str:
    weights = [f"({' * '.join(f'c{k}' if m >> k & 1 else f'(1 - c{k})' for k in range(4))})" for m in range(16)]
    mixed = [" + ".join(f"{w} * {FIXED[m][ch]!r}::DOUBLE" for m, w in enumerate(weights)) for ch in range(3)]
    pens = [f"pow(c{i} * {6 * (1 - OPTS.priority[i]) + OPTS.sparsity!r}::DOUBLE, 2)" for i in range(4)]
    pens += [f"pow(c{i} * c{j} * {22 * OPTS.sparsity!r}::DOUBLE, 2)" for i in range(4) for j in range(i + 1, 4)]
    return f"""cd0 AS (SELECT CAST(range AS INTEGER) AS cand, {", ".join(f"(range // {4**i}) % 4 / 3.0::DOUBLE AS c{i}" for i in range(4))} FROM range(256)), cd1 AS (SELECT *, {mixed[0]} AS lr, {mixed[1]} AS lg, {mixed[2]} AS lb, {' + '.join(pens)} AS pen FROM cd0), {S.lab_cte('cands', 'cd1')}"""


@query(
    "e10_match_inks",
    B.ctes("rgb21")
    + f""", {COLORS}, {TARGET}, {_cand_sql()}, cost AS (SELECT r, g, b, cand, c0, c1, c2, c3, round(pow({1.6 - OPTS.balance!r}::DOUBLE * (lab_l - tl), 2) + pow({0.6 + OPTS.balance!r}::DOUBLE * (lab_a - ta), 2) + pow({0.6 + OPTS.balance!r}::DOUBLE * (lab_b - tb), 2) + pen, 4) AS cost FROM target, cands)
SELECT r, g, b, cand, cost, round(c0, 6) AS c0, round(c1, 6) AS c1, round(c2, 6) AS c2, round(c3, 6) AS c3 FROM cost QUALIFY row_number() OVER (PARTITION BY r, g, b ORDER BY cost, cand) = 1""",
)
def e10_match_inks(spark, folder):
    found = MT.match_inks(colors(spark, folder), ["r", "g", "b"], MT.candidates(spark, FIXED, OPTS), OPTS, target())
    return found.select("r", "g", "b", "cand", R("cost", "cost", 4), *[R(f"c{i}", f"c{i}") for i in range(4)])


@query("e11_match_targets", B.ctes("rgb21") + f", {COLORS}, {TARGET} SELECT r, g, b, round(tl, 6) AS l, round(ta, 6) AS a, round(tb, 6) AS b_ FROM target")
def e11_match_targets(spark, folder):
    l, a, b = target()
    return colors(spark, folder).select("r", "g", "b", R(l, "l"), R(a, "a"), R(b, "b_"))


@query(
    "e12_lut_grid",
    B.ctes("flat_px")
    + f""", sized AS (SELECT n, CAST(floor(r * (n - 1) / 255.0::DOUBLE + 0.5) AS INTEGER) AS ri, CAST(floor(g * (n - 1) / 255.0::DOUBLE + 0.5) AS INTEGER) AS gi, CAST(floor(b * (n - 1) / 255.0::DOUBLE + 0.5) AS INTEGER) AS bi FROM flat_px, (VALUES (17), (33)) s(n))
SELECT n AS size, ri, gi, bi, count(*) AS pixels, round(max({S.lin('(ri / (n - 1)::DOUBLE)')}), 6) AS lr, round(max({S.lin('(bi / (n - 1)::DOUBLE)')}), 6) AS lb FROM sized GROUP BY 1, 2, 3, 4""",
)
def e12_lut_grid(spark, folder):
    """How the catalogue's pixels fall on the draft and the final grid."""
    px = B.flat_px(spark, folder)
    out = None
    for size in (MT.DRAFT, MT.FINAL):
        cell = [F.floor(F.col(c) * (size - 1) / 255.0 + 0.5).cast("int").alias(g) for c, g in (("r", "ri"), ("g", "gi"), ("b", "bi"))]
        counts = px.select(*cell).groupBy("ri", "gi", "bi").agg(F.count("*").alias("pixels"))
        part = counts.join(F.broadcast(MT.lut_grid(spark, size)), ["ri", "gi", "bi"]).select(F.lit(size).alias("size"), "ri", "gi", "bi", "pixels", R("lr", "lr"), R("lb", "lb"))
        out = part if out is None else out.unionByName(part)
    return out


LUT4 = "lut4 AS (SELECT label, CAST(p % 4 AS INTEGER) AS ri, CAST(p // 4 % 4 AS INTEGER) AS gi, CAST(p // 16 AS INTEGER) AS bi, avg(g) / 255.0::DOUBLE AS c0, max(g) / 255.0::DOUBLE AS c1 FROM gray8 GROUP BY label, p)"


def lut4(spark, folder, keys):
    p = F.col("p")
    g = B.gray8(spark, folder).select("label", (p % 4).alias("ri"), (F.floor(p / 4) % 4).cast("int").alias("gi"), F.floor(p / 16).cast("int").alias("bi"), "g")
    return g.groupBy(*keys, "ri", "gi", "bi").agg((F.avg("g") / 255.0).alias("c0"), (F.max("g") / 255.0).alias("c1"))


_F3 = [f"s{c} * 3 - least(2, floor(s{c} * 3))" for c in "rgb"]
_W3 = " * ".join(f"(CASE WHEN d{c} = 1 THEN f{c} ELSE 1 - f{c} END)" for c in "rgb")


@query(
    "d12_apply_lut3",
    B.ctes("gray8", "rgb21")
    + f""", lut4 AS (SELECT CAST(p % 4 AS INTEGER) AS ri, CAST(p // 4 % 4 AS INTEGER) AS gi, CAST(p // 16 AS INTEGER) AS bi, avg(g) / 255.0::DOUBLE AS c0, max(g) / 255.0::DOUBLE AS c1 FROM gray8 GROUP BY p),
{S.fractions_cte('px', 'rgb21')}, fx AS (SELECT *, {", ".join(f"{e} AS f{c}, least(2, floor(s{c} * 3)) AS i{c}" for c, e in zip("rgb", _F3))} FROM px),
cn AS (SELECT image_id, x, y, ir + dr AS ri, ig + dg AS gi, ib + db AS bi, {_W3} AS w FROM fx, (VALUES (0), (1)) a(dr), (VALUES (0), (1)) b(dg), (VALUES (0), (1)) c(db))
SELECT image_id, x, y, round(sum(w * c0), 6) AS c0, round(sum(w * c1), 6) AS c1 FROM cn JOIN lut4 USING (ri, gi, bi) GROUP BY 1, 2, 3""",
)
def d12_apply_lut3(spark, folder):
    px = B.rgb21(spark, folder).select("image_id", "x", "y", *[(F.col(c) / 255.0).alias(f"s{c}") for c in "rgb"])
    out = MT.apply_lut3(px, lut4(spark, folder, []), [], ["c0", "c1"], 4)
    return out.select("image_id", "x", "y", R("c0", "c0"), R("c1", "c1"))


def _smooth_axis(name: str, src: str, axis: str) -> str:
    part = ", ".join(["label", *[a for a in ("ri", "gi", "bi") if a != axis]])
    v = [f"(coalesce(lag({c}) OVER w, {c}) + 2 * {c} + coalesce(lead({c}) OVER w, {c})) / 4 AS {c}" for c in ("c0", "c1")]
    return f"{name} AS (SELECT label, ri, gi, bi, {', '.join(v)} FROM {src} WINDOW w AS (PARTITION BY {part} ORDER BY {axis}))"


@query(
    "d13_smooth_lut3",
    B.ctes("gray8")
    + f""", {LUT4}, {_smooth_axis('s1', 'lut4', 'ri')}, {_smooth_axis('s2', 's1', 'gi')}, {_smooth_axis('s3', 's2', 'bi')}
SELECT s.label, s.ri, s.gi, s.bi, round(CASE WHEN s.ri = 3 AND s.gi = 3 AND s.bi = 3 THEN l.c0 ELSE s.c0 END, 6) AS c0, round(CASE WHEN s.ri = 3 AND s.gi = 3 AND s.bi = 3 THEN l.c1 ELSE s.c1 END, 6) AS c1 FROM s3 s JOIN lut4 l USING (label, ri, gi, bi)""",
)
def d13_smooth_lut3(spark, folder):
    out = MT.smooth_lut3(lut4(spark, folder, ["label"]), ["label"], ["c0", "c1"], 4)
    return out.select("label", "ri", "gi", "bi", R("c0", "c0"), R("c1", "c1"))

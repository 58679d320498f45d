"""Properties, brute force on small fixtures, and files."""

import random
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tintwell import plugins
from tintwell.functions import geometry as G
from tintwell.operators import curves as D
from tintwell.operators import halftone as H
from tintwell.operators import history as J
from tintwell.operators import layout as LY
from tintwell.operators import match as MT
from tintwell.operators import palette as P
from tintwell.operators import ranks as RK
from tintwell.operators import scan
from tintwell.operators import settings as A
from tintwell.operators import spatial as SP
from tintwell.operators import split as E
from tintwell.plans.settings_queries import REGISTRY
from tintwell.sources import images as IO


@pytest.fixture(scope="module")
def skewed():
    """A log in which one key holds most rows."""
    rng = random.Random(5)
    return pd.DataFrame([(("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}"), i, rng.randrange(40) / 4.0) for i in range(2000)], columns=["k", "seq", "v"])


@pytest.mark.parametrize("per_group", [0, 10_000])
def test_ranks_are_exact_under_skew(spark, skewed, per_group):
    got = RK.value_ranks(spark.createDataFrame(skewed), ["k"], "v", per_group).toPandas()
    for (k, v), group in skewed.groupby(["k", "v"]):
        row = got[(got.k == k) & (got.v == v)].iloc[0]
        whole = skewed[skewed.k == k].v
        assert (row.n, row.below, row.total) == (len(group), (whole < v).sum(), len(whole))
    assert len(got) == skewed.groupby(["k", "v"]).ngroups


def test_ranks_of_a_large_group_span_partitions(spark):
    hot = F.when(F.col("id") % 10 > 0, "hot").when(F.col("id") % 20 > 0, "cold")
    df = spark.range(3000).select(hot.alias("k"), F.when(F.col("id") % 100 > 0, F.col("id") * 37 % 3001 / 4.0).alias("v")).repartition(4)
    ranged = RK._counted(df.groupBy("k", "v").agg(F.count("*").alias("n")).repartitionByRange(8, "k", "v").sortWithinPartitions("k", "v"), ["k"])
    assert ranged.where("k = 'hot'").select("_part").distinct().count() > 3
    got = RK.value_ranks(df, ["k"], "v", 100).toPandas()
    assert len(got) == 2970 + 1
    for _, group in got.sort_values("v", na_position="first").groupby("k", dropna=False):
        assert (group.below.to_numpy() == np.cumsum(group.n) - group.n).all() and (group.total == group.n.sum()).all()


def test_quantiles_equal_numpy(spark, skewed):
    got = H.lattice_tables(spark.createDataFrame(skewed), ["k"], "v", per_group=5).toPandas()
    for k, group in skewed.groupby("k"):
        want = np.quantile(group.v, np.arange(256) / 255)
        mine = got[got.k == k].sort_values("i").v.to_numpy()
        assert mine[0] == -1
        assert np.allclose(mine[1:], want[1:], atol=1e-12)


def test_scans_equal_plain_windows(spark, skewed):
    df = spark.createDataFrame(skewed)
    total = scan.running_sum(df, ["k"], "seq", F.col("v"), "s", width=37).toPandas().sort_values("seq")
    assert np.allclose(total.s, skewed.groupby("k").v.cumsum())
    before = scan.previous(df, ["k"], "seq", {"p": "v"}, width=37).toPandas().sort_values("seq")
    assert np.allclose(before.p.fillna(-1), skewed.groupby("k").v.shift().fillna(-1))
    rare = scan.last_known(df, ["k"], "seq", F.when(F.col("v") > 9, F.col("v")), "l", width=37).toPandas().sort_values("seq")
    assert np.allclose(rare.l.fillna(-1), skewed.v.where(skewed.v > 9).groupby(skewed.k).ffill().fillna(-1))


def test_cost_in_blocks_equals_one_loop(spark, skewed):
    got = J.fast_rise_cost(spark.createDataFrame(skewed), ["k"], "seq", "v", width=64).toPandas().sort_values("seq")
    costs, want = {}, []
    for k, _, v in skewed.itertuples(index=False):
        c = costs.get(k)
        costs[k] = v if c is None or v > c else c * 0.8 + v * 0.2
        want.append(costs[k])
    assert np.allclose(got.cost, want)


def test_dots_keep_the_tone(spark):
    ramp = spark.range(64 * 64).select(F.lit(0).alias("image_id"), (F.col("id") % 64).cast("int").alias("x"), F.floor(F.col("id") / 64).cast("int").alias("y"))
    for tone in (0.2, 0.5, 0.8):
        cov = ramp.select("*", F.lit(0).alias("ink"), F.lit(tone).alias("c"))
        pts = ramp.select("*", F.lit(0).alias("ink"), F.lit(6.3).alias("size"), F.lit(15.0).alias("degrees"))
        for name in ("am", "hex", "rings", "carry"):
            dots = plugins.run_halftone(name, pts, cov, {"width": 64, "height": 64})
            share = dots.agg(F.avg(F.col("on").cast("double"))).first()[0]
            assert abs(share - tone) < 0.035, (name, tone, share)


def test_point_set_screens_keep_the_tone(spark):
    side, tone = 48, 0.4
    ramp = spark.range(side * side).select(F.lit(0).cast("long").alias("image_id"), (F.col("id") % side).cast("int").alias("x"), F.floor(F.col("id") / side).cast("int").alias("y"))
    cov = ramp.select("*", F.lit(0).alias("ink"), F.lit(tone).alias("c"))
    pts = ramp.select("*", F.lit(0).alias("ink"), F.lit(6.3).alias("size"), F.lit(15.0).alias("degrees"))
    rng = np.random.default_rng(3)
    nudges = spark.createDataFrame([(x, y, *(float(v) for v in rng.uniform(-0.3, 0.3, 2))) for x in range(8) for y in range(8)], "tx int, ty int, nx double, ny double")
    sites = spark.createDataFrame([(i, float(x + 0.5), float(y + 0.5)) for i, (x, y) in enumerate((x, y) for x in range(-2, 12) for y in range(-4, 12))], "site int, sx double, sy double")
    # Thresholds from the spot values that the screen itself has over all points.
    far = H.on_lattice(pts).select(F.col("_qx").alias("x"), F.col("_qy").alias("y"), (F.col("y") * side + F.col("x")).alias("k"))
    noise = H.nearest_jittered(far, nudges, [], ["k", "x", "y"], 8, 1.0).select(F.struct(F.col("px").alias("x"), F.col("py").alias("y")).alias("c"), "x", "y")
    grid = far.select(F.struct((F.floor("x") + 0.5).alias("x"), (F.floor("y") + 0.5).alias("y")).alias("c"), "x", "y")
    table = lambda df: H.lattice_tables(df.select(F.lit(0).alias("k"), H.spot_offset("round", F.col("x"), F.col("y"), F.col("c")).alias("spot")), ["k"], "spot")
    field = spark.createDataFrame([(x, y, float(v)) for (x, y), v in np.ndenumerate(rng.random((48, 48)))], "tx int, ty int, v double")
    ranked = ramp.select("image_id", (F.col("y") * side + F.col("x")).alias("i"), (F.col("x") + 0.5).alias("x"), (F.col("y") + 0.5).alias("y"))
    ranked = ranked.withColumn("rank16", F.floor(F.pmod(F.col("i") * 1009, F.lit(side * side)) * 65535 / (side * side)).cast("int"))
    size = {"width": side, "height": side}
    for name, params in (
        ("noise", {"field": nudges, "tile_size": 8, "table": table(noise)}),
        ("spiral", {"sites": sites, "table": table(grid)}),
        ("stipple", {"stipple_points": ranked, "thresholds": [j / 32 for j in range(33)]}),
        ("field", {"field": field, "tile_size": 48}),
    ):
        dots = plugins.run_halftone(name, pts, cov, size | params)
        n, share = dots.agg(F.count("*"), F.avg(F.col("on").cast("double"))).first()
        assert n == side * side and abs(share - tone) < 0.03, (name, n, share)


def test_carry_round_keeps_row_totals(spark):
    rng = random.Random(1)
    rows = [(0, x, y, rng.randrange(256)) for y in range(20) for x in range(50)]
    cov = spark.createDataFrame(rows, "image_id long, x int, y int, g int")
    out = H.carry_round(cov, ["image_id", "y"], F.col("x"), "g").groupBy("y").agg(F.sum("on").alias("on"), F.sum("g").alias("g")).collect()
    assert all(abs(r["on"] - r["g"] / 255) <= 0.5 + 1e-9 for r in out)


def test_tiled_filter_equals_whole_filter(spark):
    rng = random.Random(2)
    rows = [(i, x, y, rng.random()) for i in range(2) for y in range(17) for x in range(23)]
    px = spark.createDataFrame(rows, "image_id long, x int, y int, v double")
    whole = SP.gaussian(px, ["v"], 0.9)
    margin = SP.tile_margin(sigma=0.9)
    images = spark.createDataFrame([(i, 23, 17) for i in range(2)], "image_id long, width int, height int")
    tiles = SP.tile_with_halo(px, images, 8, margin)
    assert tiles.agg(F.max("tile_x"), F.max("tile_y")).first() == (2, 2)
    alone = tiles.withColumn("image_id", F.concat_ws("/", "image_id", "tile_x", "tile_y"))
    soft = SP.gaussian(alone, ["v"], 0.9).where("own")
    soft = soft.select(F.split("image_id", "/")[0].cast("long").alias("image_id"), "x", "y", F.col("v").alias("t"))
    worst = whole.join(soft, ["image_id", "x", "y"]).agg(F.max(F.abs(F.col("v") - F.col("t"))), F.count("*")).first()
    assert worst[0] < 1e-12 and worst[1] == len(rows)


@pytest.fixture(scope="module")
def board():
    """A 70 by 9 image of noise: smaller than the neighbourhoods below."""
    return np.random.default_rng(6).random((9, 70))


def _table(spark, board, name="v"):
    return spark.createDataFrame([(0, x, y, float(board[y, x])) for y in range(9) for x in range(70)], f"image_id long, x int, y int, {name} double")


def _image(df, name="v"):
    out = np.zeros((9, 70))
    for r in df.collect():
        out[r["y"], r["x"]] = r[name]
    return out


@pytest.mark.parametrize("sigma", [2.0, 20.0])
def test_blur_reads_every_pixel_in_reach(spark, board, sigma):
    reach = int(np.ceil(2.5 * sigma))
    d = np.arange(-reach, reach + 1)
    w = np.exp(-(d**2) / (2 * sigma**2))
    want = board
    for axis, n in ((1, 70), (0, 9)):
        at = np.clip(np.arange(n)[:, None] + d, 0, n - 1)
        want = (np.take(want, at, axis=axis) * (w / w.sum())[(None, None, slice(None)) if axis else (None, slice(None), None)]).sum(axis=axis + 1)
    assert np.allclose(_image(SP.gaussian(_table(spark, board), ["v"], sigma)), want, atol=1e-12)


@pytest.mark.parametrize("radius", [40.0, -40.4, 2.5])
def test_trap_reaches_its_whole_radius(spark, board, radius):
    pick = np.max if radius > 0 else np.min
    full, part = int(abs(radius)), abs(radius) % 1
    want = board
    for axis, n in ((1, 70), (0, 9)):
        near = lambda lo, hi: np.take(want, np.clip(np.arange(n)[:, None] + np.arange(lo, hi + 1), 0, n - 1), axis=axis)  # noqa: E731, B023
        best = pick(near(-full, full), axis=axis + 1)
        for s in (-full - 1, full + 1):
            best = pick(np.stack([best, want * (1 - part) + near(s, s).squeeze(axis + 1) * part]), axis=0)
        want = best
    got = SP.trap(_table(spark, board, "c0"), [radius])
    assert np.allclose(_image(got, "c0"), want, atol=1e-12)


def test_kmeans_finds_separate_clusters_and_pins_centres(spark):
    rng = random.Random(4)
    middles = [(20, 0, 0), (60, 40, -30), (80, -50, 50)]
    rows = [(i, n, *(m + rng.gauss(0, 1) for m in middles[n % 3])) for i in range(2) for n in range(90)]
    pts = spark.createDataFrame(rows, "image_id long, pid int, l double, a double, b double")
    fixed = pts.select("image_id").distinct().select("image_id", F.lit(100.0).alias("l"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    centers = P.best_clustering(pts, ["image_id"], 4, fixed, 1, restarts=2).toPandas()
    for _, group in centers.groupby("image_id"):
        assert (group[group.cluster == 0][["l", "a", "b"]].to_numpy() == [100, 0, 0]).all()
        for m in middles:
            assert (np.linalg.norm(group[["l", "a", "b"]].to_numpy() - np.array(m), axis=1) < 1.5).any()


def test_seeds_are_drawn_by_squared_distance(spark):
    """Next to a centre at 0, points at 1, 2 and 3 are drawn 1, 4 and 9 times out of 14."""
    pts = spark.range(3000).select("id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("pid")).select(F.col("id").alias("image_id"), "pid", F.col("pid").cast("double").alias("l"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    fixed = pts.select("image_id").distinct().select("image_id", *[F.lit(0.0).alias(c) for c in "lab"])
    got = P.seed_runs(pts, ["image_id"], 2, fixed, 5, 2).where("cluster = 1").groupBy("restart", "l").count().collect()
    shares = {(r.restart, r.l): r["count"] / 3000 for r in got}
    assert all(abs(shares[r, float(d)] - d * d / 14) < 0.03 for r in (0, 1) for d in (1, 2, 3))
    same = pts.withColumn("l", F.lit(0.0)).where("image_id < 5")
    assert P.seed_runs(same, ["image_id"], 3, None, 5, 2).count() == 30


def test_auto_palette_of_two_flat_colours(spark):
    import tintwell.functions.color as C

    rows = [(1, n, "#c02020" if n % 2 else "#2030a0") for n in range(60)]
    df = spark.createDataFrame(rows, "image_id long, pid int, hex string")
    l, a, b = C.rgb_to_lab(C.hex_to_rgb(F.col("hex")))
    pts = df.select("image_id", "pid", l.alias("l"), a.alias("a"), b.alias("b"))
    got = P.auto_palette(pts, ["image_id"], 2, "#ffffff").first()
    assert sorted(got["inks"]) == ["#2030a0", "#c02020"] and got["paper"] == "#ffffff"
    # Fewer colours than inks: all of them, the darkest again, and black for an image without pixels.
    images = spark.createDataFrame([(1,), (2,)], "image_id long")
    got = {r["image_id"]: r for r in P.auto_palette(pts, ["image_id"], 4, "#ffffff", "contrast", images=images).collect()}
    assert got[1]["inks"] == ["#c02020", "#2030a0", "#2030a0", "#2030a0"] and got[2]["inks"] == ["#000000"] * 4


def test_match_equals_exhaustive_search(spark):
    from tintwell.plans.split_queries import FIXED

    opts = MT.MatchOptions(sparsity=0.2)
    cands = MT.candidates(spark, FIXED, opts)
    colors = spark.createDataFrame([(30, 90, 200), (250, 250, 250), (200, 30, 40)], "r int, g int, b int")
    import tintwell.functions.color as C

    target = MT.match_target(C.rgb_to_linear((F.col("r"), F.col("g"), F.col("b"))), FIXED, True)
    got = {tuple(r[:3]): r["cost"] for r in MT.match_inks(colors, ["r", "g", "b"], cands, opts, target).collect()}
    want = colors.select("r", "g", "b", *[t.alias(n) for t, n in zip(target, ("tl", "ta", "tb"))]).toPandas()
    table = cands.toPandas()
    sl, sab = 1.6 - opts.balance, 0.6 + opts.balance
    for row in want.itertuples(index=False):
        cost = (sl * (table.cl - row.tl)) ** 2 + (sab * (table.ca - row.ta)) ** 2 + (sab * (table.cb - row.tb)) ** 2 + table.penalty
        assert abs(cost.min() - got[(row.r, row.g, row.b)]) < 1e-6


def test_page_sizes_in_pixels(spark):
    base = dict(width=1200, height=800, margin=0.0, mode="print", digital_size="original", lock_aspect=True, digital_width=100, digital_height=100, digital_fit="fit", dpi=600, units="mm", page_size="letter", page_width=1.0, page_height=1.0, orientation="portrait", bleed_mm=0.0, margin_mm=5.0, placement="fit", image_width=4.0, position_x=50, position_y=50)
    rows = [base, {**base, "page_size": "a4"}, {**base, "page_size": "a4", "bleed_mm": 3.0}, {**base, "page_size": "image", "units": "in", "dpi": 300, "margin": 32.0}]
    got = [(r[0], r[1]) for r in LY.output_layout(spark.createDataFrame(pd.DataFrame(rows))).select("layout.width", "layout.height").collect()]
    assert got[0] == (5100, 6600) and got[1] == (4961, 7016) and got[2][0] == 5102
    assert got[3] == (1200, 820)


def test_border_of_four_percent(spark):
    row = spark.range(1).select(G.border_geometry(F.lit(1200), F.lit(800), F.lit("ink"), F.lit(4.0), F.lit(0.0), F.lit(9), F.lit(3)).alias("b")).select("b.*").first()
    assert (row["margin"], row["mode"], row["ink"]) == (32.0, 1, 2)


def test_levels_keep_a_straight_curve(spark):
    pts = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 1.0, 1.0)], "k int, seq int, x double, y double")
    settings = spark.createDataFrame([(1, 0.0, 1.0, 0.0, False, 1.0)], "k int, black double, white double, mid double, invert boolean, density double")
    lut = D.tone_lut(settings, D.sample_curves(pts, ["k"], 1024), ["k"])
    assert lut.where("i <> v").isEmpty() and lut.count() == 256


def test_inverse_of_a_table_undoes_it(spark):
    rows = [(1, i, (i / 64) ** 2) for i in range(65)]
    inv = D.invert_lut(spark.createDataFrame(rows, "k int, i int, v double"), ["k"], 64).toPandas().sort_values("i")
    assert np.abs(inv.v.to_numpy() - np.sqrt(np.arange(256) / 255)).max() < 0.01


def test_conform_is_idempotent(spark):
    registry = A.registry_table(spark, REGISTRY)
    raw = spark.createDataFrame([(1, "adjust", "blackPoint", 0, "900"), (1, "palette", "inkColor", 2, '"#ABCDEF"'), (1, "nothing", "here", 0, "1")], "project long, section string, key string, slot int, value string")
    once = A.conform(raw, registry, raw.select("project"))
    twice = A.conform(once, registry, once.select("project"))
    # A default longer than its own limit is only cut once it is given as a value.
    checked = lambda df: sorted(map(tuple, df.where("key <> 'projectName'").collect()))
    assert checked(once) == checked(twice)
    values = {(r["section"], r["key"], r["slot"]): r["value"] for r in once.collect()}
    assert values[("adjust", "blackPoint", 0)] == "100.0" and values[("palette", "inkColor", 2)] == '"#abcdef"'
    assert ("nothing", "here", 0) not in values


def test_ink_orders():
    assert A.remove_order(1) == [0, 2, 3, 1]
    assert A.move_order(0, 1, 3) == [1, 0, 2, 3]
    assert A.move_order(2, 1, 3) == [0, 1, 2, 3]


def png(path, width, height, pixel):
    """Writes an 8-bit RGB PNG."""
    raw = b"".join(b"\x00" + b"".join(bytes(pixel(x, y)) for x in range(width)) for y in range(height))
    chunk = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images_decode_to_pixels(spark, tmp_path):
    png(tmp_path / "a.png", 5, 3, lambda x, y: (x * 40, y * 80, 7))
    png(tmp_path / "b.png", 2, 2, lambda x, y: (255, 0, x))
    (tmp_path / "c.png").write_bytes(b"not an image")
    px = IO.pixels_from_images(spark, str(tmp_path))
    rows = {(r["path"][-5:], r["x"], r["y"]): (r["r"], r["g"], r["b"], r["a"]) for r in px.collect()}
    assert len(rows) == 19
    assert rows[("a.png", 4, 2)] == (160, 160, 7, 255) and rows[("b.png", 1, 0)] == (255, 0, 1, 255)
    left_out = IO.unreadable_images(spark, str(tmp_path)).collect()
    assert [(r["path"][-5:], r["reason"]) for r in left_out] == [("c.png", "cannot be decoded")]
    listed = A.ingest_gate(IO.list_files(spark, str(tmp_path)).withColumns({"width": F.lit(1), "height": F.lit(1)}))
    ok, rejects = A.split_gate(listed)
    assert ok.count() == 3 and rejects.isEmpty()


def test_a_large_image_decodes_whole(spark, tmp_path):
    png(tmp_path / "big.png", 1500, 900, lambda x, y: (x % 256, y % 256, (x + y) % 256))
    px = IO.pixels_from_images(spark, str(tmp_path))
    right = (F.col("r") == F.col("x") % 256) & (F.col("g") == F.col("y") % 256) & (F.col("b") == (F.col("x") + F.col("y")) % 256)
    got = px.agg(F.count("*"), F.sum(right.cast("int")), F.countDistinct(F.col("y") * 1500 + F.col("x"))).first()
    assert tuple(got) == (1350000, 1350000, 1350000)


def test_layers_read_back_as_written(spark, tmp_path):
    rows = [(i, x, y, (x + i) / 9, y / 9, 0.25, 1.0) for i in range(5) for y in range(6) for x in range(4)]
    cov = spark.createDataFrame(rows, "image_id long, x int, y int, c0 double, c1 double, c2 double, c3 double")
    inks = spark.createDataFrame([(0, "#0078bf"), (1, "#ff48b0"), (2, "#ffe800"), (3, "#000000")], "ink int, hex string")
    layers = IO.layer_rows(cov, inks, "Two / names")
    IO.write_layers(layers, str(tmp_path / "out"))
    back = IO.read_layers(spark, str(tmp_path / "out"))
    cols = ["image_id", "print_order", "layer", "x", "y", "v"]
    assert sorted(map(tuple, back.select(*cols).collect())) == sorted(map(tuple, layers.select(*cols).collect()))
    assert back.where("print_order = 1").first()["layer"] == "Two - names_01_0078BF"
    assert IO.read_layers(spark, str(tmp_path / "out"), 4).select("v").distinct().collect()[0][0] == 0


def test_selective_split_sends_red_to_its_ink(spark):
    px = spark.createDataFrame([(0, 0, 0, 255, 0, 0), (0, 1, 0, 128, 128, 128)], "image_id long, x int, y int, r int, g int, b int")
    out = plugins.run_split("selective", px, {"ranges": [E.ColorRange(hue=0, ink=1, light_max=1.0)], "base": 3}).orderBy("x").collect()
    assert out[0]["c1"] == pytest.approx(1.0) and out[0]["c3"] == pytest.approx(0.0)
    assert out[1]["c1"] == 0 and out[1]["c3"] == pytest.approx(1 - 128 / 255)


def test_unknown_names_are_refused(spark):
    with pytest.raises(KeyError):
        plugins.run_split("nope", spark.range(1))
    with pytest.raises(KeyError):
        plugins.run_halftone("nope", spark.range(1), spark.range(1))
    assert plugins.SPLITS["detail"].reach({"sigma": 2.0}) == 7.0
    assert plugins.margin_of("detail", {"sigma": 2.0}, "am", {"sizes": [10.0]}, 1.0) == 15 + 2.5 + 7 + 2 + 0.5


def test_prepared_tables_are_built_once_per_key(spark, tmp_path):
    built = []

    def prepare(session, params, quality):
        built.append(quality)
        return {"level": session.createDataFrame([(params["ink"], 0.25 if quality == "draft" else 0.5)], "k int, v double")}

    @plugins.split_method("flat_test", prepare=prepare, prepare_key=lambda p: p["ink"], depends_on=lambda p: p.get("table"), needs_prepare=lambda p: not p.get("off"))
    def render(pixels, params, tables):
        if not tables:
            return pixels.select("image_id", "x", "y", *[F.lit(0.0).alias(f"c{k}") for k in range(4)])
        v = tables["level"].select("v")
        return pixels.crossJoin(F.broadcast(v)).select("image_id", "x", "y", *[(F.col("v") if k == params["ink"] else F.lit(0.0)).alias(f"c{k}") for k in range(4)])

    try:
        px = spark.createDataFrame([(0, 0, 0, 9, 9, 9)], "image_id long, x int, y int, r int, g int, b int")
        run = lambda **p: [(q, df.first()["c1"]) for q, df in plugins.preview_split("flat_test", px, {"ink": 1} | p, str(tmp_path))]
        assert run() == run() == [("draft", 0.25), ("final", 0.5)] and built == ["draft", "final"]
        assert run(table=[1, 2]) == [("draft", 0.25), ("final", 0.5)] and built == ["draft", "final"] * 2
        assert run(off=True) == [("final", 0.0)] and len(built) == 4
        key = lambda name, **p: plugins.render_key(name, p)
        assert key("flat_test", ink=1, table=[1]) != key("flat_test", ink=1, table=[2])
        assert key("channel", space="cmyk", table=[1]) == key("channel", space="cmyk", table=[2]) != key("channel", space="lab")
        with pytest.raises(TypeError):
            plugins.table_key(plugins.SPLITS["flat_test"], {"ink": px})
    finally:
        del plugins.SPLITS["flat_test"]


def test_prepared_screens_keep_the_tone(spark):
    side, tone = 48, 0.4
    ramp = spark.range(side * side).select(F.lit(0).cast("long").alias("image_id"), (F.col("id") % side).cast("int").alias("x"), F.floor(F.col("id") / side).cast("int").alias("y"))
    cov = ramp.select("*", F.lit(0).alias("ink"), F.lit(tone).alias("c"))
    pts = ramp.select("*", F.lit(0).alias("ink"), F.lit(5.3).alias("size"), F.lit(15.0).alias("degrees"))
    for name, params in (("noise", {"tile_size": 16, "kind": "green"}), ("spiral", {"points": 2048}), ("carry", {"dot_size": 3.0})):
        dots = plugins.run_halftone(name, pts, cov, {"width": side, "height": side} | params)
        n, share = dots.agg(F.count("*"), F.avg(F.col("on").cast("double"))).first()
        assert n == side * side and abs(share - tone) < 0.04, (name, n, share)

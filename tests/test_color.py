"""Golden colours, round trips and bounds."""

import random

from pyspark.sql import functions as F

from tintwell.functions import color as C
from tintwell.functions import hashing
from tintwell.operators import mix as M
from tintwell.operators.layers import ink_limit, knockout

BLUE, PINK, YELLOW = "#0078bf", "#ff48b0", "#ffe800"


def test_golden_overlaps_on_white(spark):
    rows = [("p", "#ffffff", [(0, BLUE, 0.0), (1, PINK, 0.0), (2, YELLOW, 0.0)])]
    palettes = spark.createDataFrame(rows, "palette string, paper string, inks array<struct<ink:int,hex:string,opacity:double>>")
    table = M.overlap_table(palettes, ["palette"])
    rgb = C.linear_to_rgb(C.gamut_compress((F.col("r"), F.col("g"), F.col("b"))))
    found = {r[0]: r[1] for r in table.select("mask", C.rgb_to_hex(rgb)).collect()}
    assert found[0] == "#ffffff"
    assert (found[1], found[2], found[4]) == (BLUE, PINK, YELLOW)
    assert found[5] == "#05712a"
    assert found[3] == "#2f1982"
    assert found[6] == "#fb480f"
    assert found[7] == "#28241b"


def test_opaque_ink_hides_what_is_below(spark):
    rows = [("p", "#000000", [(0, PINK, 1.0)])]
    palettes = spark.createDataFrame(rows, "palette string, paper string, inks array<struct<ink:int,hex:string,opacity:double>>")
    table = M.overlap_table(palettes, ["palette"]).where("mask = 1")
    rgb = C.linear_to_rgb(C.gamut_compress((F.col("r"), F.col("g"), F.col("b"))))
    assert table.select(C.rgb_to_hex(rgb)).first()[0] == PINK


def test_all_bytes_round_trip(spark):
    px = spark.range(4096).select(*[(F.col("id") * k % 256).cast("int").alias(c) for c, k in zip("rgb", (7, 31, 101))])
    rgb = (F.col("r"), F.col("g"), F.col("b"))
    back = C.lab_to_rgb(C.rgb_to_lab(rgb))
    oklch = C.oklch_to_rgb(C.rgb_to_oklch(rgb))
    bad = px.select(*[(a != b).alias(f"l{i}") for i, (a, b) in enumerate(zip(rgb, back))], *[(F.abs(a - b) > 1).alias(f"o{i}") for i, (a, b) in enumerate(zip(rgb, oklch))])
    assert bad.where("l0 or l1 or l2 or o0 or o1 or o2").isEmpty()


def test_hex_forms(spark):
    df = spark.createDataFrame([(" #AbC ",), ("aabbcc",), ("#12345",), ("",)], "h string")
    got = [tuple(r) for r in df.select(*C.hex_to_rgb(F.col("h"))).collect()]
    assert got == [(170, 187, 204), (170, 187, 204), (None, None, None), (None, None, None)]


def test_gain_and_its_inverse(spark):
    df = spark.range(101).select((F.col("id") / 100.0).alias("c"))
    for curve in ("midtone", "uniform"):
        a = F.lit(0.12)
        worst = df.select(F.max(F.abs(C.dot_gain_inverse(C.dot_gain(F.col("c"), a, curve), a, curve) - F.least(F.col("c"), F.lit(1 / 1.24 if curve == "uniform" else 1.0))))).first()[0]
        assert worst < 1e-9


def test_demichel_weights_add_up_and_limits_hold(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([tuple(rng.random() for _ in range(4)) for _ in range(200)], "c0 double, c1 double, c2 double, c3 double")
    cov = [F.col(f"c{k}") for k in range(4)]
    total = sum(M.demichel(cov)[1:], M.demichel(cov)[0])
    limited = ink_limit(cov, 1.5)
    row = df.select(F.max(F.abs(total - 1)), F.max(sum(limited[1:], limited[0])), F.max(knockout(cov, [False, False, False, True])[0] - F.col("c0"))).first()
    assert row[0] < 1e-12
    assert row[1] <= 1.5 + 1e-12
    assert row[2] <= 0


def test_hashes_match_plain_arithmetic(spark):
    def pcg(v):
        s = (v * 747796405 + 2891336453) & 0xFFFFFFFF
        w = (((s >> ((s >> 28) + 4)) ^ s) * 277803737) & 0xFFFFFFFF
        return (w >> 22) ^ w

    def mulberry(seed, k):
        a = (seed + (k + 1) * 0x6D2B79F5) & 0xFFFFFFFF
        t = ((a ^ (a >> 15)) * (a | 1)) & 0xFFFFFFFF
        t = ((t + ((t ^ (t >> 7)) * (t | 61))) & 0xFFFFFFFF) ^ t
        return (t ^ (t >> 14)) / 4294967296

    seeds = [0, 1, 12345, 2**31, 2**32 - 1]
    df = spark.createDataFrame([(s,) for s in seeds], "s long")
    for s, p, m in df.select("s", hashing.pcg(F.col("s")), hashing.mulberry(F.col("s"), 2)).collect():
        assert p == pcg(s)
        assert abs(m - mulberry(s, 2)) < 1e-15


def test_gamut_search_runs_once_over_batches(spark):
    """The three bytes share one search outside the row's expressions; nulls and odd values keep their meaning."""
    rows = [(0.7, 0.4, 30.0), (0.7, 0.0, 30.0), (0.5, 0.01, 200.0), (0.5, 0.1, None), (None, 0.0, 10.0), (0.5, float("nan"), 10.0), (2.0, 0.1, 10.0)]
    df = spark.createDataFrame(rows, "l double, c double, h double")
    out = df.select(C.rgb_to_hex(C.oklch_to_rgb((F.col("l"), F.col("c"), F.col("h")))).alias("hex"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "aggregate(" not in plan
    got = [r["hex"] for r in out.collect()]
    assert got[1] == "#9e9e9e" and got[3:] == ["#000000", "#000000", "#636363", "#ffffff"]
    # As the search was, row by row: chroma halves 24 times.
    lin = lambda k: C.oklab_to_linear((F.lit(0.7), k * F.cos(F.radians(F.lit(30.0))), k * F.sin(F.radians(F.lit(30.0)))))
    found = C.let(C.bisect(lambda mid: C.in_gamut(lin(mid)), F.lit(0.0), F.lit(0.4), 24), lambda k: F.array(*C.linear_to_rgb(lin(k))))
    assert got[0] == spark.range(1).select(C.rgb_to_hex(tuple(F.get(found, F.lit(i)) for i in range(3)))).first()[0]

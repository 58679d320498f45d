"""Ink matching: the coverage that best reproduces each colour, and 3-D lookup tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tintwell.functions import color as C
from tintwell.functions.color import Triple, clamp01, half_up, num
from tintwell.operators.mix import mix
from tintwell.operators.split import MAX_INKS
from tintwell.session import constant_rows

LEVELS = 4
DRAFT, FINAL = 17, 33


@dataclass(frozen=True)
class MatchOptions:
    """Preferences of the match, all 0..1."""

    priority: tuple[float, ...] = (0.5, 0.5, 0.5, 0.5)
    sparsity: float = 0.5
    balance: float = 0.5
    compress: bool = True


def lut_grid(spark, size: int) -> DataFrame:
    """Grid of size^3 sRGB colours: ri, gi, bi and linear lr, lg, lb."""
    n = F.col("id")
    at = spark.range(size**3).select((n % size).cast("int").alias("ri"), F.floor(n / size % size).cast("int").alias("gi"), F.floor(n / (size * size)).cast("int").alias("bi"))
    lin = [C.srgb_to_linear(F.col(c) / float(size - 1)).alias(o) for c, o in (("ri", "lr"), ("gi", "lg"), ("bi", "lb"))]
    return at.select("*", *lin)


def reachable(table: list[tuple[float, float, float]]) -> tuple[float, float]:
    """Darkest and lightest L* of a fixed overlap table."""
    def f(t: float) -> float:
        return t ** (1 / 3) if t > 0.008856 else 7.787 * t + 16 / 116

    ls = [116 * f(sum(w * v for w, v in zip(C.RGB_TO_XYZ[1], rgb))) - 16 for rgb in table]
    return min(ls), max(ls)


def match_target(lin: Triple, table: list[tuple[float, float, float]], compress: bool) -> Triple:
    """Lab a colour should become: relative to the paper, lightness fitted into what the inks reach."""
    if not compress:
        return C.linear_to_lab(lin)
    paper = table[0]
    l, a, b = C.linear_to_lab(tuple(c * float(p) for c, p in zip(lin, paper)))
    lo, hi = reachable(table)
    return l / max(1e-6, hi) * (hi - lo) + lo, a, b


def candidates(spark, table: list[tuple[float, float, float]], opts: MatchOptions, inks: int = MAX_INKS) -> DataFrame:
    """All mixes of four levels per ink: cand, c0.., Lab and the penalty of ink use and overlaps (4^n rows)."""
    k = F.col("id")
    rows = spark.range(LEVELS**inks).select(k.cast("int").alias("cand"), *[(F.floor(k / LEVELS**i) % LEVELS / 3.0).alias(f"c{i}") for i in range(inks)])
    cov = [F.col(f"c{i}") for i in range(inks)]
    lab = C.linear_to_lab(mix(cov, table))
    penalty = num(0)
    for i in range(inks):
        weight = 6 * (1 - opts.priority[i]) + opts.sparsity
        penalty = penalty + (cov[i] * weight) * (cov[i] * weight)
    for i in range(inks):
        for j in range(i + 1, inks):
            both = cov[i] * cov[j] * (22 * opts.sparsity)
            penalty = penalty + both * both
    return rows.select("cand", *[c for c in rows.columns if c != "cand"], *[v.alias(n) for v, n in zip(lab, ("cl", "ca", "cb"))], penalty.alias("penalty"))


def match_inks(colors: DataFrame, keys: list[str], cands: DataFrame, opts: MatchOptions, target: Triple, inks: int = MAX_INKS) -> DataFrame:
    """Best candidate of every distinct colour: keys, cand, cost, c0...

    The candidates (at most 256 rows) travel as one constant-size array next to
    each distinct colour, which then takes the cheapest in place; no pair of
    colour and candidate becomes a row. Distinct colours fold first.
    """
    sl, sab = 1.6 - opts.balance, 0.6 + opts.balance
    fields = ["cand", "cl", "ca", "cb", "penalty", *[f"c{i}" for i in range(inks)]]
    wanted = colors.groupBy(*keys).agg(F.lit(1).alias("_one")).select(*keys, F.struct(*[t.alias(n) for t, n in zip(target, "lab")]).alias("_t"))
    table = constant_rows(cands.select(*fields).orderBy("cand"), LEVELS**inks)

    def cost(c: Column) -> Column:
        dl, da, db = (c["cl"] - F.col("_t.l")) * sl, (c["ca"] - F.col("_t.a")) * sab, (c["cb"] - F.col("_t.b")) * sab
        return dl * dl + da * da + db * db + c["penalty"]

    best = F.array_min(F.transform(table, lambda c: F.struct(cost(c).alias("cost"), c["cand"].alias("cand"), *[c[f"c{i}"].alias(f"c{i}") for i in range(inks)])))
    return wanted.select(*keys, best.alias("_m")).select(*keys, "_m.*")


def lut_cells(lut: DataFrame, keys: list[str], values: list[str], size: int) -> DataFrame:
    """Eight corner values of every grid cell in one row: keys, ri, gi, bi, corner arrays.

    Prepared once per table (size^3 rows), so that a pixel needs one equi-join
    instead of eight and no aggregation.
    """
    shifts = [(i, j, k) for k in (0, 1) for j in (0, 1) for i in (0, 1)]
    last = size - 1
    offers = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for n, (i, j, k) in enumerate(shifts)]))
    sent = lut.select(*keys, "ri", "gi", "bi", *values, offers.alias("o"))
    sent = sent.select(*keys, *[(F.col(c) - F.col(f"o.{s}")).alias(c) for c, s in (("ri", "i"), ("gi", "j"), ("bi", "k"))], F.col("o.n").alias("n"), *values)
    inside = sent.where((F.col("ri") >= 0) & (F.col("gi") >= 0) & (F.col("bi") >= 0) & (F.col("ri") < last) & (F.col("gi") < last) & (F.col("bi") < last))
    return inside.groupBy(*keys, "ri", "gi", "bi").agg(*[F.array(*[F.max(F.when(F.col("n") == n, F.col(v))) for n in range(8)]).alias(v) for v in values])


def apply_lut3(pixels: DataFrame, lut: DataFrame, keys: list[str], values: list[str], size: int) -> DataFrame:
    """Trilinear lookup of sRGB fractions sr, sg, sb: pixels' columns plus the values."""
    cells = lut_cells(lut, keys, values, size)
    last = size - 1
    at = pixels
    for c, g in (("sr", "ri"), ("sg", "gi"), ("sb", "bi")):
        at = at.withColumn(g, F.least(F.lit(last - 1), F.floor(clamp01(F.col(c)) * last).cast("int")))
    joined = at.join(cells, [*keys, "ri", "gi", "bi"])
    share = [clamp01(F.col(c)) * last - F.col(g) for c, g in (("sr", "ri"), ("sg", "gi"), ("sb", "bi"))]
    joined = joined.withColumns({"_fr": share[0], "_fg": share[1], "_fb": share[2]})
    fr, fg, fb = F.col("_fr"), F.col("_fg"), F.col("_fb")
    out = []
    for v in values:
        total = num(0)
        for n in range(8):
            w = (fr if n & 1 else num(1) - fr) * (fg if n & 2 else num(1) - fg) * (fb if n & 4 else num(1) - fb)
            total = total + w * F.get(v, F.lit(n))
        out.append(total.alias(v))
    return joined.select(*pixels.columns, *out)


def smooth_lut3(lut: DataFrame, keys: list[str], values: list[str], size: int) -> DataFrame:
    """[1 2 1] / 4 along each axis with edges repeated; the white corner keeps its values."""
    axes = ["ri", "gi", "bi"]
    kept = lut.select(*keys, *axes, *values, *[F.col(v).alias(f"_{v}") for v in values])
    for axis in axes:
        order = Window.partitionBy(*keys, *[a for a in axes if a != axis]).orderBy(axis)  # one grid line
        step = lambda v: (F.coalesce(F.lag(v).over(order), F.col(v)) + F.col(v) * 2 + F.coalesce(F.lead(v).over(order), F.col(v))) / 4
        kept = kept.select(*keys, *axes, *[step(v).alias(v) for v in values], *[f"_{v}" for v in values])
    white = (F.col("ri") == size - 1) & (F.col("gi") == size - 1) & (F.col("bi") == size - 1)
    return kept.select(*keys, *axes, *[F.when(white, F.col(f"_{v}")).otherwise(F.col(v)).alias(v) for v in values])


def ink_lut(spark, table: list[tuple[float, float, float]], opts: MatchOptions, size: int = FINAL, inks: int = MAX_INKS) -> DataFrame:
    """Smoothed table of the best coverage for a grid of colours, in bytes: ri, gi, bi, c0.. (0..255)."""
    grid = lut_grid(spark, size)
    target = match_target((F.col("lr"), F.col("lg"), F.col("lb")), table, opts.compress)
    names = [f"c{i}" for i in range(inks)]
    found = match_inks(grid, ["ri", "gi", "bi", "lr", "lg", "lb"], candidates(spark, table, opts, inks), opts, target, inks)
    smooth = smooth_lut3(found.select("ri", "gi", "bi", *names), [], names, size)
    return smooth.select("ri", "gi", "bi", *[half_up(clamp01(F.col(c)) * 255).cast("int").alias(c) for c in names])

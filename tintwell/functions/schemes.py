"""Colour schemes: palettes grown from one colour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tintwell.functions import color as C

# Hue turns of each scheme, first colour first, and the four stand-ins for CMYK.
ROTATIONS = {"complementary": [180], "analogous": [-30, 30], "triad": [120, 240], "square": [90, 180, 270]}
CMYK_HEXES = ["#3255a4", "#ff48b0", "#ffe800", "#000000"]


def _slots() -> Column:
    """One struct per scheme slot: how lightness, chroma and hue derive from the first colour."""
    rows = []

    def add(scheme: str, slot: int, turn=0.0, dl=0.0, lo=0.0, hi=1.0, kc=1.0, fixed=None):
        rows.append(
            F.struct(
                F.lit(scheme).alias("scheme"),
                F.lit(slot).alias("slot"),
                C.num(turn).alias("turn"),
                C.num(dl).alias("dl"),
                C.num(lo).alias("lo"),
                C.num(hi).alias("hi"),
                C.num(kc).alias("kc"),
                F.lit(fixed).cast("string").alias("fixed"),
            )
        )

    for scheme, turns in ROTATIONS.items():
        for slot, turn in enumerate(turns, start=1):
            add(scheme, slot, turn=turn)
    add("monotone", 1, dl=0.25, hi=0.95, kc=0.55)
    add("monotone", 2, dl=-0.25, lo=0.12, kc=0.9)
    for slot, value in enumerate(CMYK_HEXES):
        add("cmyk", slot, fixed=value)
    return F.array(*rows)


def scheme_colors(bases: DataFrame, key: str, hex_col: str) -> DataFrame:
    """Every scheme's colours for every first colour: key, scheme, slot, hex (slot 0 is the first colour)."""
    l, c, h = C.rgb_to_oklch(C.hex_to_rgb(F.col(hex_col)))
    base = bases.select(F.col(key), F.col(hex_col).alias("base_hex"), l.alias("l"), c.alias("c"), h.alias("h"))
    grown = base.select("*", F.explode(_slots()).alias("s"))
    hue = F.col("h") + F.col("s.turn") + 360
    hue = F.when(hue >= 720, hue - 720).when(hue >= 360, hue - 360).otherwise(hue)
    light = F.least(F.col("s.hi"), F.greatest(F.col("s.lo"), F.col("l") + F.col("s.dl")))
    made = C.rgb_to_hex(C.oklch_to_rgb((light, F.col("c") * F.col("s.kc"), hue)))
    derived = grown.select(key, F.col("s.scheme").alias("scheme"), F.col("s.slot").alias("slot"), F.coalesce("s.fixed", made).alias("hex"))
    names = F.array(*[F.lit(n) for n in (*ROTATIONS, "monotone")])
    first = base.select(key, F.explode(names).alias("scheme"), F.lit(0).alias("slot"), F.col("base_hex").alias("hex"))
    return first.unionByName(derived)


def paper_tint(hex_col: Column) -> Column:
    """A very light, gently coloured paper of the same hue."""
    _, c, h = C.rgb_to_oklch(C.hex_to_rgb(hex_col))
    return C.rgb_to_hex(C.oklch_to_rgb((C.num(0.95), F.least(c, C.num(0.035)), h)))


def with_background(colors: DataFrame, key: str) -> DataFrame:
    """Gives the lightest colour other than the first to the paper: key, scheme, inks (joined hexes), paper."""
    l, _, _ = C.rgb_to_oklch(C.hex_to_rgb(F.col("hex")))
    free = (F.col("slot") > 0) | (F.col("scheme") == "cmyk")
    lit = colors.withColumn("l", F.when(free, l))
    # Ties go to the earlier slot: max_by on (l, -slot).
    grouped = lit.groupBy(key, "scheme").agg(
        F.max_by(F.col("slot"), F.when(free, F.struct("l", -F.col("slot")))).alias("bg"),
        F.array_sort(F.collect_list(F.struct("slot", "hex"))).alias("slots"),  # at most four slots per scheme
    )
    kept = F.filter("slots", lambda s: s["slot"] != F.col("bg"))
    chosen = F.element_at(F.filter("slots", lambda s: s["slot"] == F.col("bg")), 1)["hex"]
    # A tint reads its colour many times, so that is a column of its own.
    found = grouped.select(key, "scheme", F.array_join(F.transform(kept, lambda s: s["hex"]), " ").alias("inks"), chosen.alias("_chosen"))
    return found.select(key, "scheme", "inks", paper_tint(F.col("_chosen")).alias("paper"))

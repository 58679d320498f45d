"""From ink coverage back to colour: solid overlaps and their area-weighted mix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tintwell.functions import color as C
from tintwell.functions import spectral
from tintwell.functions.color import Triple, clamp01, let, num
from tintwell.operators.split import MAX_INKS


def palette_key(inks: DataFrame, key: str, paper: Column) -> DataFrame:
    """Text that is equal for palettes that print alike: key, paper, inks (ordered structs), palette_key."""
    rows = inks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ink", "hex", "opacity"))).alias("inks"))  # at most four inks
    parts = F.transform("inks", lambda i: F.concat_ws(":", i["hex"], i["opacity"].cast("string")))
    return rows.select(key, paper.alias("paper"), "inks", F.concat_ws("|", paper, F.array_join(parts, "|")).alias("palette_key"))


def overlap_table(palettes: DataFrame, keys: list[str]) -> DataFrame:
    """Linear colour of every solid ink combination: keys, mask, r, g, b.

    `palettes`: keys, paper (hex), inks (array of struct(ink, hex, opacity) in
    print order, up to four). Band by band, each printed ink filters what is
    below it by its squared transmittance; an opaque share covers it instead.
    """
    white = spectral.base_spectra()["w"]

    def reflectance(hex_col: Column) -> Column:
        return let(F.array(*C.rgb_to_linear(C.hex_to_rgb(hex_col))), lambda e: spectral.linear_to_reflectance(tuple(F.get(e, F.lit(i)) for i in range(3))))

    prepared = palettes.select(
        *keys,
        reflectance(F.col("paper")).alias("paper"),
        F.transform("inks", lambda i: F.struct(reflectance(i["hex"]).alias("r"), clamp01(i["opacity"]).alias("a"))).alias("inks"),
    )
    film = lambda r: F.zip_with(r, spectral.spectrum_column(white), lambda v, w: F.least(num(1), v / w))
    # What an ink lets through and what it adds, once per ink.
    through = lambda i: F.transform(film(i["r"]), lambda t: (num(1) - i["a"]) * t)
    added = lambda i: F.transform(i["r"], lambda r: i["a"] * r)
    layers = prepared.select(*keys, "paper", F.transform("inks", lambda i: F.struct(through(i).alias("t"), added(i).alias("o"))).alias("inks"))

    def printed(stack: Column, ink: Column) -> Column:
        """The combinations with the ink on top follow those without it, so the place in the list is the mask."""
        over = lambda below: F.zip_with(F.zip_with(below, ink["t"], lambda b, t: b * t), ink["o"], lambda f, o: f + o)
        return F.concat(stack, F.transform(stack, over))

    spectrum = layers.select(*keys, F.posexplode(F.aggregate("inks", F.array("paper"), printed)).alias("mask", "s"))
    r, g, b = spectral.reflectance_to_linear(F.col("s"))
    return spectrum.select(*keys, "mask", r.alias("r"), g.alias("g"), b.alias("b"))


def overlap_tables_distinct(inks: DataFrame, key: str, paper: Column) -> DataFrame:
    """Overlap tables of all palettes, each distinct setup computed once: key, mask, r, g, b."""
    keyed = palette_key(inks, key, paper)
    distinct = keyed.groupBy("palette_key").agg(F.first("paper").alias("paper"), F.first("inks").alias("inks"))
    tables = overlap_table(distinct, ["palette_key"])
    return keyed.select(key, "palette_key").join(tables, "palette_key").drop("palette_key")


def demichel(cov: list[Column]) -> list[Column]:
    """Area share of every ink combination, indexed by mask; the shares add up to 1."""
    out = [num(1)]
    for c in (clamp01(c) for c in cov):
        # Bit i of the mask is ink i, so each ink doubles the list upwards.
        out = [w * (num(1) - c) for w in out] + [w * c for w in out]
    return out


def mix(cov: list[Column], table: list[tuple[float, float, float]]) -> Triple:
    """Linear colour of partial coverage over one fixed overlap table, unrolled into one expression."""
    weights = demichel(cov)[: len(table)]
    out = []
    for ch in range(3):
        total = num(0)
        for w, rgb in zip(weights, table):
            total = total + w * float(rgb[ch])
        out.append(total)
    return out[0], out[1], out[2]


def wide_overlaps(overlap: DataFrame, keys: list[str]) -> DataFrame:
    """Overlap rows as one array of 2^n colours per palette (at most 16): keys, colors."""
    return overlap.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("mask", "r", "g", "b"))).alias("colors"))


def mix_by_palette(cov: DataFrame, overlap: DataFrame, keys: list[str], ink_count: int = MAX_INKS) -> DataFrame:
    """The same mix with each row's own palette: one join per row instead of sixteen; adds r, g, b (linear)."""
    joined = cov.join(wide_overlaps(overlap, keys), keys)
    weights = demichel([F.col(f"c{k}") for k in range(ink_count)])
    colors = [F.get("colors", F.lit(m)) for m in range(1 << ink_count)]
    out = []
    for ch in ("r", "g", "b"):
        total = num(0)
        for w, c in zip(weights, colors):
            total = total + w * c[ch]
        out.append(total.alias(ch))
    return joined.select(*cov.columns, *out)


def mask_of(bits: list[Column]) -> Column:
    """Ink on/off flags to a combination mask."""
    total = F.lit(0)
    for i, b in enumerate(bits):
        total = total + b.cast("int") * (1 << i)
    return total


def mask_color(df: DataFrame, overlap: DataFrame, keys: list[str], mask: str = "mask") -> DataFrame:
    """Colour of each row's ink combination, by equi-join on palette and mask."""
    return df.join(overlap.withColumnRenamed("mask", mask), [*keys, mask])


def samples_per_axis(ratio: Column) -> Column:
    """Sub-samples needed per axis for a given number of output pixels per screen pixel."""
    return F.greatest(F.lit(2), F.least(F.lit(8), F.ceil(ratio * 1.5).cast("int")))


def supersample(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Averages sub-samples in linear light and encodes the result: keys, r, g, b (bytes), n."""
    mean = samples.groupBy(*keys).agg(F.avg("r").alias("r"), F.avg("g").alias("g"), F.avg("b").alias("b"), F.count("*").alias("n"))
    r, g, b = C.linear_to_rgb(C.gamut_compress((F.col("r"), F.col("g"), F.col("b"))))
    return mean.select(*keys, r.alias("r"), g.alias("g"), b.alias("b"), "n")


def unmix_paper(mixed: Triple, cov: list[Column], paper: Triple) -> tuple[Column, Column, Column, Column]:
    """Ink colour without its paper, and how much of the pixel is inked; nothing below 0.002."""
    bare = num(1)
    for c in cov:
        bare = bare * (num(1) - c)
    alpha = num(1) - bare
    inked = alpha > 0.002
    out = [F.when(inked, clamp01((m - bare * p) / alpha)).otherwise(num(0)) for m, p in zip(mixed, paper)]
    return out[0], out[1], out[2], F.when(inked, alpha).otherwise(num(0))

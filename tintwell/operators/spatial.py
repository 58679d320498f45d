"""Neighbourhoods and geometry of pixel tables keyed by image_id, x, y.

Separable filters run once along rows and once along columns: narrow blurs as
window expressions over a line, all others over segments of lines with a margin,
so that a very large image spreads over thousands of partitions either way.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tintwell.functions import color as C
from tintwell.functions.color import clamp01, num
from tintwell.session import cut_lineage

KEY = ["image_id", "x", "y"]


def line(axis: str) -> WindowSpec:
    """Window along one axis: "x" walks a row, "y" walks a column."""
    return Window.partitionBy("image_id", "y" if axis == "x" else "x").orderBy(axis)


def shifted(value: str | Column, d: int, axis: str) -> Column:
    """Value d pixels along the axis, repeating the edge pixel."""
    w = line(axis)
    c = F.col(value) if isinstance(value, str) else value
    if d == 0:
        return c
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.coalesce(F.lag(c, -d).over(w), F.first(c).over(whole)) if d < 0 else F.coalesce(F.lead(c, d).over(w), F.last(c).over(whole))


#: Taps on a side up to which a blur is written as window expressions; wider ones run over segments of lines.
WINDOW_TAPS = 16
#: Least pixels of a segment; wide neighbourhoods take segments of four times their reach, so that margins stay small.
SEGMENT = 1024


def bell(sigma: float) -> list[float]:
    """Weights of all whole-pixel offsets within 2.5 sigma, which sum to 1."""
    reach = math.ceil(2.5 * sigma)
    raw = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-reach, reach + 1)]
    return [w / sum(raw) for w in raw]


class Segments:
    """Pixels of several segments of lines in a row, each with its margin. A read past a segment repeats its end pixel.

    A segment that ends inside its margin ends where its line ends, so that repeats the line's own end.
    """

    def __init__(self, first: np.ndarray):
        self.rows = len(first)
        self.starts = np.flatnonzero(first)
        self.sizes = np.diff(np.append(self.starts, self.rows))
        self._at = np.arange(self.rows)
        self._low = np.repeat(self.starts, self.sizes)
        self._high = self._low + np.repeat(self.sizes, self.sizes) - 1

    def off(self, d: int) -> np.ndarray:
        """Index of the pixel d along."""
        return np.clip(self._at + d, self._low, self._high)

    def highest(self, values: np.ndarray, reach: int) -> np.ndarray:
        """Highest value within `reach` on both sides, by running maxima from both ends of blocks of a window's width.

        Each window is the end of one block and the start of the next, so the work does not grow with the reach.
        """
        reach = min(reach, int(self.sizes.max(initial=1)))
        at = self._at + np.repeat(np.arange(1, len(self.starts) + 1) * reach, self.sizes)
        width = 2 * reach + 1
        room = np.full(-(-(self.rows + (len(self.starts) + 1) * reach) // width) * width, -np.inf)
        room[at] = values
        blocks = room.reshape(-1, width)
        upto = np.maximum.accumulate(blocks, axis=1).ravel()
        onward = np.maximum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        return np.maximum(onward[at - reach], upto[at + reach])


def on_segments(df: DataFrame, axis: str, reach: int, outputs) -> DataFrame:
    """Rows with the columns that `outputs(columns, segments)` returns replaced; both sides hold Numpy arrays.

    Each line (a row or column of an image, without gaps) is cut into segments of bounded length, and a pixel also goes to
    the segments whose margin it lies in. So an image of any width spreads over tasks, a task holds one Arrow batch and
    one segment, and all segments of a batch are computed at once. Null values count as not a number.
    """
    across, size = "y" if axis == "x" else "x", max(SEGMENT, 4 * reach)
    names = [c for c in df.columns if df.schema[c].dataType.typeName() == "double"]
    schema = to_arrow_schema(df.schema)
    segment = F.sequence(F.floor((F.col(axis) - reach) / size), F.floor((F.col(axis) + reach) / size))
    rows = df.withColumn("_segment", F.explode(segment)).repartition("image_id", across, "_segment")
    rows = rows.sortWithinPartitions("image_id", across, "_segment", axis)

    def differs(column: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.not_equal(column[1:], column[:-1]), True).to_numpy(zero_copy_only=False)

    def firsts(batch: pa.RecordBatch) -> np.ndarray:
        out = np.ones(batch.num_rows, dtype=bool)
        if batch.num_rows > 1:
            out[1:] = differs(batch.column("image_id")) | differs(batch.column(across)) | differs(batch.column("_segment"))
        return out

    def done(batch: pa.RecordBatch, first: np.ndarray) -> pa.RecordBatch:
        columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
        new = outputs(columns, Segments(first))
        own = batch.column("_segment").to_numpy() == batch.column(axis).to_numpy() // size
        arrays = [pa.array(new[f.name], f.type) if f.name in new else batch.column(f.name) for f in schema]
        return pa.record_batch(arrays, schema=schema).filter(pa.array(own))

    def run(batches):
        held = None
        for batch in batches:
            whole = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            first = firsts(whole)
            # The last segment may go on in the next batch.
            cut = int(np.flatnonzero(first)[-1]) if len(first) else 0
            if cut:
                yield done(whole.slice(0, cut), first[:cut])
            held = whole.slice(cut)
        if held is not None and held.num_rows:
            yield done(held, firsts(held))

    return rows.mapInArrow(run, df.schema)


def blur_axis(df: DataFrame, values: list[str], sigma: float, axis: str) -> DataFrame:
    """One direction of a Gaussian blur of the named columns."""
    weights = bell(sigma)
    reach = len(weights) // 2
    if reach > WINDOW_TAPS:

        def blurred(columns, segments):
            out = {v: np.zeros(segments.rows) for v in values}
            for d, w in zip(range(-reach, reach + 1), weights):
                at = segments.off(d)
                for v in values:
                    out[v] += columns[v][at] * w
            return out

        return on_segments(df, axis, reach, blurred)
    out = {}
    for v in values:
        acc = num(0)
        for d, w in zip(range(-reach, reach + 1), weights):
            acc = acc + shifted(v, d, axis) * w
        out[v] = acc
    keep = [c for c in df.columns if c not in values]
    return df.select(*keep, *[c.alias(n) for n, c in out.items()])


def gaussian(df: DataFrame, values: list[str], sigma: float) -> DataFrame:
    """Separable Gaussian blur, edges repeated."""
    return blur_axis(blur_axis(df, values, sigma, "x"), values, sigma, "y")


def gaussian_wrapped(tile: DataFrame, keys: list[str], value: str, sigma: float, size: int) -> DataFrame:
    """Separable Gaussian blur on a wrapping size x size tile (keys, tx, ty, value).

    Each cell sends its weighted value to the cells it reaches, so wrapping is a
    modulo and the sum is a partial aggregation.
    """
    radius = math.ceil(sigma * 3)
    weights = [(d, math.exp(-(d * d) / (2 * sigma * sigma))) for d in range(-radius, radius + 1)]
    total = sum(w for _, w in weights)
    spread = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), num(w / total).alias("w")) for d, w in weights]))
    for axis in ("tx", "ty"):
        other = "ty" if axis == "tx" else "tx"
        sent = tile.select(*keys, "tx", "ty", value, spread.alias("s"))
        sent = sent.select(*keys, other, F.pmod(F.col(axis) + F.col("s.d"), F.lit(size)).alias(axis), (F.col(value) * F.col("s.w")).alias(value))
        tile = sent.groupBy(*keys, "tx", "ty").agg(F.sum(value).alias(value))
    return tile


def bilateral_axis(df: DataFrame, sigma: float, axis: str, spread: float = 0.12) -> DataFrame:
    """One direction of an edge-preserving blur of linear r, g, b: unlike neighbours count less."""
    names, weights = ["r", "g", "b"], bell(sigma)
    reach = len(weights) // 2
    encoded = df.withColumns({f"_s{n}": C.linear_to_srgb(F.col(n)) for n in names})

    def smoothed(columns, segments):
        total, sums = np.zeros(segments.rows), {n: np.zeros(segments.rows) for n in names}
        for d, w in zip(range(-reach, reach + 1), weights):
            at = segments.off(d)
            away = sum((columns[f"_s{n}"][at] - columns[f"_s{n}"]) ** 2 for n in names)
            w = w * np.exp(-away / (2 * spread * spread))
            total += w
            for n in names:
                sums[n] += columns[n][at] * w
        return {n: sums[n] / total for n in names}

    return on_segments(encoded, axis, reach, smoothed).select(*df.columns)


def bilateral(df: DataFrame, sigma: float, spread: float = 0.12) -> DataFrame:
    """Separable edge-preserving blur of linear r, g, b."""
    return bilateral_axis(bilateral_axis(df, sigma, "x", spread), sigma, "y", spread)


def sobel(df: DataFrame, value: str = "lum", keep: tuple[str, ...] = ()) -> DataFrame:
    """Sobel gradient of one column: image_id, x, y, value, the columns to keep, gx, gy."""
    left, right = shifted(value, -1, "x"), shifted(value, 1, "x")
    rows = df.select(*KEY, value, *keep, (right - left).alias("_d"), (left + F.col(value) * 2 + right).alias("_s"))
    gx = shifted("_d", -1, "y") + F.col("_d") * 2 + shifted("_d", 1, "y")
    gy = shifted("_s", 1, "y") - shifted("_s", -1, "y")
    return rows.select(*KEY, value, *keep, gx.alias("gx"), gy.alias("gy"))


def analysis(pixels: DataFrame) -> DataFrame:
    """Luminance and gradient of linear r, g, b pixels, gradient clipped to -1..1."""
    lum = C.luminance((F.col("r"), F.col("g"), F.col("b")))
    edges = sobel(pixels.select(*KEY, lum.alias("lum")))
    clip = lambda c: F.least(num(1), F.greatest(num(-1), F.col(c)))
    return edges.select(*KEY, "lum", clip("gx").alias("gx"), clip("gy").alias("gy"))


def orientation(pixels: DataFrame, sigma: float) -> DataFrame:
    """Smoothed edge direction: image_id, x, y, cos2, sin2 (times strength), strength, coherence."""
    a = analysis(pixels)
    g2 = F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")
    safe = F.greatest(g2, num(1e-300))
    m = clamp01(F.sqrt(g2) * 3)
    # cos and sin of the doubled angle come straight from the components.
    tensor = a.select(
        *KEY,
        ((F.col("gx") * F.col("gx") - F.col("gy") * F.col("gy")) / safe * m).alias("cos2"),
        (F.col("gx") * F.col("gy") * 2 / safe * m).alias("sin2"),
        m.alias("strength"),
    )
    soft = gaussian(tensor, ["cos2", "sin2", "strength"], sigma)
    length = F.sqrt(F.col("cos2") * F.col("cos2") + F.col("sin2") * F.col("sin2"))
    return soft.select("*", F.when(F.col("strength") > 1e-3, length / F.col("strength")).otherwise(num(0)).alias("coherence"))


def trap_axis(cov: DataFrame, radius: list[float], axis: str) -> DataFrame:
    """One direction of choke (negative radius) or spread (positive) per ink; the last pixel counts in part."""
    names = [f"c{k}" for k in range(len(radius))]

    def moved(columns, segments):
        out = {}
        for name, r in zip(names, radius):
            # A choke is the spread of the negative.
            sign, full = (1 if r >= 0 else -1), math.floor(abs(r))
            c, part = sign * columns[name], abs(r) - full
            best = segments.highest(c, full) if full else c
            if part:
                for d in (-full - 1, full + 1):
                    best = np.maximum(best, c * (1 - part) + c[segments.off(d)] * part)
            out[name] = sign * best + 0.0
        return out

    return on_segments(cov, axis, math.floor(max(map(abs, radius))) + 1, moved)


def trap(cov: DataFrame, radius: list[float]) -> DataFrame:
    return trap_axis(trap_axis(cov, radius, "x"), radius, "y")


def disc_reach(tile: DataFrame, keys: list[str], size: int, samples: int = 4) -> DataFrame:
    """Lowest threshold among the round dots that reach each of samples^2 points of a cell: keys, tx, ty, sx, sy, reach.

    Every cell sends its threshold to the nine cells around it, on the wrapping tile, so a group is a cell with nine
    neighbours, not each of its points; a point keeps the smallest of the dots that reach it.
    """
    sides = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    sent = tile.select(*keys, "tx", "ty", "threshold", F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(k).alias("k")) for k, (dx, dy) in enumerate(sides)])).alias("_o"))
    sent = sent.select(
        *keys,
        F.pmod(F.col("tx") + F.col("_o.dx"), F.lit(size)).alias("tx"),
        F.pmod(F.col("ty") + F.col("_o.dy"), F.lit(size)).alias("ty"),
        F.col("_o.k").alias("_k"),
        "threshold",
    )
    lowest = [F.min(F.when(F.col("_k") == k, F.col("threshold"))).alias(f"_t{k}") for k in range(len(sides))]
    # Which neighbours there are: a cell that is missing reaches nothing, one without a threshold reaches with null.
    near = sent.groupBy(*keys, "tx", "ty").agg(*lowest, F.bit_or(F.expr("shiftleft(1, _k)")).alias("_have"))
    points = []
    for sy in range(samples):
        for sx in range(samples):
            # The point lies in the cell at (dx, dy) from the dot's own cell.
            off = lambda d, s: d + (s + 0.5) / samples - 0.5
            reached = [k for k, (dx, dy) in enumerate(sides) if off(dx, sx) ** 2 + off(dy, sy) ** 2 <= 0.5]
            least = F.least(*[F.col(f"_t{k}") for k in reached]) if len(reached) > 1 else F.col(f"_t{reached[0]}")
            met = F.col("_have").bitwiseAND(sum(1 << k for k in reached)) != 0
            points.append(F.struct(F.lit(sx).alias("sx"), F.lit(sy).alias("sy"), least.alias("reach"), met.alias("met")))
    return near.select(*keys, "tx", "ty", F.explode(F.array(*points)).alias("_p")).where("_p.met").select(*keys, "tx", "ty", "_p.sx", "_p.sy", "_p.reach")


# ---- geometry ----


def turn_crop(pixels: DataFrame, images: DataFrame) -> DataFrame:
    """Quarter turn and crop, an exact remap: pixels' columns with the new x, y.

    `images`: image_id, width, height, turn (0, 90, 180, 270), crop_x, crop_y,
    crop_w, crop_h in turned pixels. The image record joins on image_id; a very
    large image is split by adaptive skew handling, and nothing else shuffles.
    """
    from tintwell.functions.geometry import turned_point

    joined = pixels.join(images.select("image_id", "width", "height", "turn", "crop_x", "crop_y", "crop_w", "crop_h"), "image_id")
    tx, ty = turned_point(F.col("x"), F.col("y"), F.col("width"), F.col("height"), F.col("turn"))
    keep = [c for c in pixels.columns if c not in KEY]
    moved = joined.select("image_id", (tx - F.col("crop_x")).alias("x"), (ty - F.col("crop_y")).alias("y"), *keep, "crop_w", "crop_h")
    inside = (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < F.col("crop_w")) & (F.col("y") < F.col("crop_h"))
    return moved.where(inside).select("image_id", "x", "y", *keep)


def straighten(pixels: DataFrame, images: DataFrame, values: list[str]) -> DataFrame:
    """Rotation about the frame centre with bilinear sampling, edges repeated.

    `images`: image_id, width, height, degrees (positive is clockwise). Output
    pixels are generated from the records, ask for up to four source pixels, and
    sum what comes back; (image, pixel) keys spread a big image evenly.
    """
    grid = images.select("*", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    grid = grid.select("*", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))
    a = F.radians("degrees")
    dx, dy = F.col("x") + 0.5 - F.col("width") / 2, F.col("y") + 0.5 - F.col("height") / 2
    grid = grid.withColumns(
        {
            "_u": F.cos(a) * dx + F.sin(a) * dy + F.col("width") / 2 - 0.5,
            "_v": F.cos(a) * dy - F.sin(a) * dx + F.col("height") / 2 - 0.5,
        }
    )
    grid = grid.withColumns({"_i": F.floor("_u").cast("int"), "_j": F.floor("_v").cast("int")})
    fu, fv = F.col("_u") - F.col("_i"), F.col("_v") - F.col("_j")
    corners = F.array(
        *[
            F.struct(
                F.least(F.col("width") - 1, F.greatest(F.lit(0), F.col("_i") + i)).alias("sx"),
                F.least(F.col("height") - 1, F.greatest(F.lit(0), F.col("_j") + j)).alias("sy"),
                ((fu if i else num(1) - fu) * (fv if j else num(1) - fv)).alias("w"),
            )
            for j in (0, 1)
            for i in (0, 1)
        ]
    )
    asked = grid.select("image_id", "x", "y", F.explode(corners).alias("c")).select("image_id", "x", "y", "c.*").where(F.col("w") > 0)
    source = pixels.select("image_id", F.col("x").alias("sx"), F.col("y").alias("sy"), *values)
    found = asked.join(source, ["image_id", "sx", "sy"])
    return found.groupBy(*KEY).agg(*[(F.sum(F.col(v) * F.col("w")) / F.sum("w")).alias(v) for v in values])


def _shares(at: Column, side: Column, target: Column) -> Column:
    """Output cells one source pixel falls into along an axis, with the covered length."""
    lo, hi = at * target / side, (at + 1) * target / side
    first = F.floor(lo).cast("int")
    last = F.least(target - 1, F.ceil(hi).cast("int") - 1)
    return F.transform(
        F.sequence(first, F.greatest(first, last)),
        lambda o: F.struct(o.alias("o"), (F.least(hi, o + 1.0) - F.greatest(lo, o.cast("double"))).alias("w")),
    )


def resample(pixels: DataFrame, images: DataFrame, values: list[str]) -> DataFrame:
    """Area-weighted average onto a smaller grid: image_id, x, y, values.

    `images`: image_id, width, height, out_w, out_h. For whole ratios every
    source pixel lands in one cell; otherwise it is shared by area. The average
    is a partial aggregation, so large images shrink before they are shuffled.
    """
    joined = pixels.join(images.select("image_id", "width", "height", "out_w", "out_h"), "image_id")
    xs = joined.select("*", F.explode(_shares(F.col("x"), F.col("width"), F.col("out_w"))).alias("_sx"))
    ys = xs.select("*", F.explode(_shares(F.col("y"), F.col("height"), F.col("out_h"))).alias("_sy"))
    w = F.col("_sx.w") * F.col("_sy.w")
    cells = ys.where(w > 1e-12).select("image_id", F.col("_sx.o").alias("x"), F.col("_sy.o").alias("y"), w.alias("_w"), *values)
    return cells.groupBy(*KEY).agg(*[(F.sum(F.col(v) * F.col("_w")) / F.sum("_w")).alias(v) for v in values])


def pyramid(pixels: DataFrame, images: DataFrame, values: list[str], stop: int = 128) -> DataFrame:
    """All levels of a halving pyramid (sides rounded up) until the long side is at most `stop`: level, image_id, x, y, values.

    Level k is averaged straight from level k - 1, which is written first, so the
    source is read once; the number of levels is the logarithm of the largest side.
    """
    sizes = images.select("image_id", "width", "height")
    level = pixels.select(*KEY, *values)
    out = level.withColumn("level", F.lit(0))
    longest = sizes.agg(F.max(F.greatest("width", "height"))).first()[0] or 0
    for k in range(1, 64):
        if longest <= stop:
            break
        half = lambda c: F.ceil(F.col(c) / 2).cast("int")
        sizes = sizes.where(F.greatest("width", "height") > stop).select("image_id", "width", "height", half("width").alias("out_w"), half("height").alias("out_h"))
        level = cut_lineage(resample(level, sizes, values))
        out = out.unionByName(level.withColumn("level", F.lit(k)))
        sizes = sizes.select("image_id", F.col("out_w").alias("width"), F.col("out_h").alias("height"))
        longest = -(-longest // 2)
    return out


def clip(pixels: DataFrame, x: int, y: int, width: int, height: int, margin: int) -> DataFrame:
    """Pixels of a region and its margin: plain comparisons that reach the file scan."""
    return pixels.where(
        (F.col("x") >= x - margin) & (F.col("x") < x + width + margin) & (F.col("y") >= y - margin) & (F.col("y") < y + height + margin)
    )


def tile_margin(reach: float = 0, sigma: float = 0, split: float = 0) -> int:
    """Pixels around a tile that its result may depend on."""
    return math.ceil(reach + sigma * 2.5 + split + 2)


def tile_with_halo(pixels: DataFrame, images: DataFrame, size: int, margin: int) -> DataFrame:
    """Sends every pixel to each tile of its image whose widened square holds it: tile_x, tile_y, own, pixel columns.

    `images` (image_id, width, height) says where the tiles end; a margin may be wider than a tile.
    """

    def span(axis: str, side: str) -> Column:
        first = F.greatest(F.lit(0), F.floor((F.col(axis) - margin) / size).cast("int"))
        return F.sequence(first, F.least(F.ceil(F.col(side) / size).cast("int") - 1, F.floor((F.col(axis) + margin) / size).cast("int")))

    cols = pixels.columns
    sized = pixels.join(images.select("image_id", F.col("width").alias("_w"), F.col("height").alias("_h")), "image_id")
    wide = sized.select("*", F.explode(span("x", "_w")).alias("tile_x")).select("*", F.explode(span("y", "_h")).alias("tile_y"))
    own = (F.floor(F.col("x") / size) == F.col("tile_x")) & (F.floor(F.col("y") / size) == F.col("tile_y"))
    return wide.select("tile_x", "tile_y", own.alias("own"), *cols)


def tile_plan(images: DataFrame, size: int) -> DataFrame:
    """All tiles of every output: image_id, tile_x, tile_y, x0, y0, tw, th."""
    cols = F.sequence(F.lit(0), F.ceil(F.col("width") / size).cast("int") - 1)
    rows = F.sequence(F.lit(0), F.ceil(F.col("height") / size).cast("int") - 1)
    tiles = images.select("*", F.explode(rows).alias("tile_y")).select("*", F.explode(cols).alias("tile_x"))
    x0, y0 = F.col("tile_x") * size, F.col("tile_y") * size
    return tiles.select(
        *images.columns,
        "tile_x",
        "tile_y",
        x0.alias("x0"),
        y0.alias("y0"),
        F.least(F.lit(size), F.col("width") - x0).alias("tw"),
        F.least(F.lit(size), F.col("height") - y0).alias("th"),
    )


def misses_art(art_x: Column, art_y: Column, art_w: Column, art_h: Column) -> Column:
    """Does a planned tile lie wholly outside the artwork?"""
    x0, y0 = F.col("x0"), F.col("y0")
    return (x0 >= art_x + art_w) | (x0 + F.col("tw") <= art_x) | (y0 >= art_y + art_h) | (y0 + F.col("th") <= art_y)


def prune_tiles(tiles: DataFrame, rendered: DataFrame, fill: float) -> DataFrame:
    """Rendered tiles plus constant rows for tiles that miss the artwork (`missed`): image_id, tile_x, tile_y, v."""
    key = ["image_id", "tile_x", "tile_y"]
    drawn = rendered.join(tiles.where(~F.col("missed")).select(*key), key, "left_semi")
    blank = tiles.where(F.col("missed")).select(*key, num(fill).alias("v"))
    return drawn.select(*key, "v").unionByName(blank)


def sample_at(pixels: DataFrame, points: DataFrame) -> DataFrame:
    """Average colour of the 3x3 pixels around each point, in linear light: image_id, point, hex.

    `pixels`: image_id, x, y, r, g, b, a (bytes). Points ask for nine exact
    positions, so this is an equi-join on (image, x, y).
    """
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for j in (-1, 0, 1) for i in (-1, 0, 1)]))
    asked = points.select("image_id", "point", "px", "py", around.alias("o"))
    asked = asked.select("image_id", "point", (F.col("px") + F.col("o.i")).alias("x"), (F.col("py") + F.col("o.j")).alias("y"))
    seen = asked.join(pixels.where(F.col("a") > 0), KEY)
    lin = [C.byte_to_linear(F.col(c)) for c in "rgb"]
    mean = seen.groupBy("image_id", "point").agg(*[F.avg(c).alias(n) for c, n in zip(lin, "rgb")])
    encoded = tuple(C.linear_to_srgb(F.col(c)) * 255 for c in "rgb")
    return mean.select("image_id", "point", C.rgb_to_hex(encoded).alias("hex"))

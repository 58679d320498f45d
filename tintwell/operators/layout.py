"""Output pages, borders, fades, printer marks and export checks over image records."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tintwell.functions import color as C
from tintwell.functions import geometry as G
from tintwell.functions.color import clamp01, half_up, num
from tintwell.operators.spatial import KEY

MM_PER_INCH = 25.4
# Page sizes in mm, digital scale factors, export limits.
PAGES = {"letter": (215.9, 279.4), "legal": (215.9, 355.6), "tabloid": (279.4, 431.8), "a4": (210.0, 297.0), "a3": (297.0, 420.0), "b4": (257.0, 364.0)}
SCALES = {"half": 0.5, "original": 1.0, "double": 2.0, "triple": 3.0}
MAX_EDGE = 32768
MAX_PIXELS = 1_000_000_000
MAX_PDF_INCHES = 200
MAX_JPG_EDGE = 16384
MAX_JPG_PIXELS = 120_000_000


def _choice(key: Column, table: dict, part) -> Column:
    return F.create_map(*[F.lit(v) for k, row in table.items() for v in (k, float(part(row)))])[key]


def output_layout(images: DataFrame) -> DataFrame:
    """Size of the output file and where the artwork sits in it: images' columns plus `layout`.

    Needs width, height, margin (image px the border adds), mode, and the export
    settings as columns: digital_size, lock_aspect, digital_width, digital_height,
    digital_fit, dpi, units, page_size, page_width, page_height, orientation,
    bleed_mm, margin_mm, placement, image_width, position_x, position_y.
    """
    c = F.col
    one = num(1)
    rows = images.withColumns({"_a": c("width") + c("margin") * 2.0, "_b": c("height") + c("margin") * 2.0})
    is_print = c("mode") == "print"
    to_px = lambda v: F.when(c("units") == "mm", v / MM_PER_INCH).otherwise(v) * c("dpi")
    mm_px = lambda v: v / MM_PER_INCH * c("dpi")
    a, b = c("_a"), c("_b")

    free = (~is_print) & (c("digital_size") == "custom") & (~c("lock_aspect"))
    image_only = is_print & (c("page_size") == "image")
    page = is_print & (c("page_size") != "image")
    custom = c("page_size") == "custom"
    known = F.when(c("page_size").isin(*PAGES), c("page_size")).otherwise("letter")
    pw0 = F.when(custom, to_px(c("page_width"))).otherwise(mm_px(_choice(known, PAGES, lambda r: r[0])))
    ph0 = F.when(custom, to_px(c("page_height"))).otherwise(mm_px(_choice(known, PAGES, lambda r: r[1])))
    rows = rows.withColumns({"_pw0": pw0, "_ph0": ph0, "_bleed": mm_px(c("bleed_mm"))})
    swap = (c("orientation") == "landscape") != (c("_pw0") > c("_ph0"))
    rows = rows.withColumns({"_pw": F.when(swap, c("_ph0")).otherwise(c("_pw0")), "_ph": F.when(swap, c("_pw0")).otherwise(c("_ph0"))})
    rows = rows.withColumn("_m", F.least(mm_px(c("margin_mm")), c("_pw") / 2 - 1, c("_ph") / 2 - 1))

    whole = lambda v: F.greatest(one, half_up(v))
    # Artwork scale that sets the size of files without a page.
    free_w, free_h = whole(c("digital_width").cast("double")), whole(c("digital_height").cast("double"))
    free_s = F.when(c("digital_fit") == "fill", F.greatest(free_w / a, free_h / b)).otherwise(F.least(free_w / a, free_h / b))
    scaled = F.when(c("digital_size") == "custom", F.greatest(one, c("digital_width").cast("double")) / a).otherwise(F.coalesce(_choice(c("digital_size"), SCALES, lambda r: r), one))
    placed = F.greatest(one, to_px(c("image_width"))) / a
    rows = rows.withColumn("_s0", F.when(free, free_s).when(image_only, placed).otherwise(scaled))
    rows = rows.withColumns(
        {
            "_w": F.when(page, whole(c("_pw") + c("_bleed") * 2)).when(free, free_w).otherwise(whole(a * c("_s0"))),
            "_h": F.when(page, whole(c("_ph") + c("_bleed") * 2)).when(free, free_h).otherwise(whole(b * c("_s0"))),
            "_qw": c("_pw") - c("_m") * 2,
            "_qh": c("_ph") - c("_m") * 2,
        }
    )
    fill, own = c("placement") == "fill", c("placement") == "custom"
    page_s = (
        F.when(fill, F.greatest(c("_w") / a, c("_h") / b)).when(own, placed).otherwise(F.greatest(num(1e-3), F.least(c("_qw") / a, c("_qh") / b)))
    )
    rows = rows.withColumn("_s", F.when(page, page_s).otherwise(c("_s0")))
    aw, ah = a * c("_s"), b * c("_s")
    qx, qy = c("_bleed") + c("_m"), c("_bleed") + c("_m")
    centred = free | (page & fill)
    ax = F.when(centred, (c("_w") - aw) / 2).when(page & own, qx + (c("_qw") - aw) * c("position_x") / 100).when(page, qx + (c("_qw") - aw) / 2).otherwise(num(0))
    ay = F.when(centred, (c("_h") - ah) / 2).when(page & own, qy + (c("_qh") - ah) * c("position_y") / 100).when(page, qy + (c("_qh") - ah) / 2).otherwise(num(0))
    art = G.rect(ax, ay, aw, ah)
    trim = G.rect(
        F.when(page, c("_bleed")).otherwise(num(0)),
        F.when(page, c("_bleed")).otherwise(num(0)),
        F.when(page, c("_pw")).otherwise(c("_w")),
        F.when(page, c("_ph")).otherwise(c("_h")),
    )
    layout = F.struct(
        F.when(is_print, "print").otherwise("digital").alias("kind"),
        F.when(is_print, c("dpi")).alias("dpi"),
        c("_w").cast("bigint").alias("width"),
        c("_h").cast("bigint").alias("height"),
        trim.alias("trim"),
        F.when(page, G.rect(qx, qy, c("_qw"), c("_qh"))).alias("printable"),
        art.alias("art"),
        F.when(page & fill, trim).otherwise(art).alias("cut"),
        c("_s").alias("scale"),
        (ax + c("margin") * c("_s")).alias("image_x"),
        (ay + c("margin") * c("_s")).alias("image_y"),
    )
    return rows.select(*images.columns, layout.alias("layout"))


def export_plan(laid: DataFrame) -> DataFrame:
    """Kind, format and size of every export, with the reason it cannot be made (null = fine).

    Needs layout, mode, print_target, file_format, digital_format.
    """
    is_print = F.col("mode") == "print"
    w, h = F.col("layout.width"), F.col("layout.height")
    kind = F.when(~is_print, "digital").when(F.col("print_target") == "standard", "standard").otherwise("riso")
    fmt = F.when(is_print, F.when(F.col("file_format") == "pdf", "pdf").otherwise("png")).otherwise(F.when(F.col("digital_format") == "jpg", "jpg").otherwise("png"))
    edge = F.greatest(w, h)
    problem = (
        F.when((edge > MAX_EDGE) | (w * h > MAX_PIXELS), "too large")
        .when((fmt == "pdf") & (edge / F.col("layout.dpi") > MAX_PDF_INCHES), "pdf page too large")
        .when((fmt == "jpg") & ((w * h > MAX_JPG_PIXELS) | (edge > MAX_JPG_EDGE)), "jpg too large")
    )
    return laid.select(*laid.columns, kind.alias("kind"), fmt.alias("format"), problem.alias("problem"))


def _fade_entries(kind: np.ndarray, midpoint: np.ndarray, custom: np.ndarray) -> np.ndarray:
    """256 entries of each of several fades; `custom` holds 1024 samples of each, where it has a curve of its own."""
    rows = np.arange(len(kind))[:, None]

    def base(x: np.ndarray) -> np.ndarray:
        own = custom[rows, np.floor(x * 1023 + 0.5).astype(int)]
        smooth, steep = 1 - x * x * (3 - x * 2), 1 - (np.exp(x * 4) - 1) / (math.exp(4) - 1)
        k = kind[:, None]
        return np.where(k == "linear", 1 - x, np.where(k == "exponential", steep, np.where(k == "custom", own, smooth)))

    grid = np.broadcast_to(np.arange(1025) / 1024.0, (len(kind), 1025))
    off = base(grid) - 0.5
    a, b = off[:, :-1], off[:, 1:]
    exact, passes = a == 0, ((a > 0) & (b <= 0)) | ((a < 0) & (b >= 0))
    at = np.argmax(exact | passes, axis=1)
    one = np.arange(len(kind))
    y0, y1 = a[one, at], b[one, at]
    span = np.where(y0 == y1, 1.0, y0 - y1)
    half = np.where(exact[one, at], at / 1024.0, np.where(passes[one, at], at / 1024.0 + y0 / span / 1024.0, 0.5))
    half = np.clip(half, 0.001, 0.999)
    power = np.log(half) / np.log(np.clip(midpoint / 100.0, 0.05, 0.95))
    v = np.clip(base((np.arange(256) / 255.0) ** power[:, None]), 0, 1)
    v[:, 0], v[:, 255] = 1, 0
    return v


def fade_tables(settings: DataFrame, custom: DataFrame, keys: list[str]) -> DataFrame:
    """Fade strength by share of the fade distance, 256 entries in a row per setting: keys, table.

    `settings`: keys, kind (linear, smooth, exponential, custom), midpoint (percent). `custom`: keys, i, v sampled at 1024
    for the custom ones. A custom curve joins its setting as one array; the fades of a batch are computed together.
    """
    from tintwell.operators.curves import as_arrays

    rows = settings.select(*keys, "kind", F.col("midpoint").cast("double").alias("midpoint")).join(as_arrays(custom, keys, "_own"), keys, "left")
    schema = StructType([*[rows.schema[k] for k in keys], StructField("table", ArrayType(DoubleType(), False))])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                own = np.full((part.num_rows, 1024), np.nan)
                for i, samples in enumerate(part.column("_own")):
                    if samples.is_valid:
                        own[i] = samples.values.to_numpy(zero_copy_only=False)
                kind, midpoint = (part.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "midpoint"))
                ends = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * 256)
                tables = pa.ListArray.from_arrays(ends, pa.array(_fade_entries(kind, midpoint, own).ravel())).cast(arrow.field("table").type)
                yield pa.record_batch([*[part.column(k) for k in keys], tables], schema=arrow)

    return rows.mapInArrow(run, schema)


def fade_luts(settings: DataFrame, custom: DataFrame, keys: list[str]) -> DataFrame:
    """The same as rows: keys, i, v."""
    return fade_tables(settings, custom, keys).select(*keys, F.posexplode("table").alias("i", "v"))


def apply_fade(pixels: DataFrame, images: DataFrame, luts: DataFrame) -> DataFrame:
    """Blends sRGB fractions sr, sg, sb towards black or white near the edge.

    `images`: image_id, x0, y0, x1, y1 (visible edge), radius, distance, tint
    (0 or 1), opacity. `luts`: image_id, table (`fade_tables`), which joins the few image records first.
    """
    from tintwell.operators.curves import read_array

    joined = pixels.join(images.join(luts, "image_id"), "image_id")
    sdf = G.rounded_rect_sdf(F.col("x") + 0.5, F.col("y") + 0.5, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.col("radius"))
    found = joined.withColumn("_d", -sdf / F.col("distance"))
    inner = read_array(F.col("table"), F.col("_d"), each=lambda v: half_up(v * 255) / 255.0)
    k = F.when(F.col("_d") <= 0, num(1)).when(F.col("_d") >= 1, num(0)).otherwise(inner) * F.col("opacity")
    keep = [c for c in pixels.columns if c not in ("sr", "sg", "sb")]
    return found.withColumn("_k", k).select(*keep, *[(F.col(c) + (F.col("tint") - F.col(c)) * F.col("_k")).alias(c) for c in ("sr", "sg", "sb")])


def apply_frame(cov: DataFrame, images: DataFrame) -> DataFrame:
    """Solid ink or bare paper over the frame: its ink becomes 1 there, the others 0.

    `images`: image_id and `border` as made by `border_geometry`.
    """
    joined = cov.join(images.select("image_id", "border"), "image_id")
    b = F.col("border")
    sdf = G.rounded_rect_sdf(F.col("x") + 0.5, F.col("y") + 0.5, b["x0"], b["y0"], b["x1"], b["y1"], b["radius"])
    covered = (b["mode"] != 0) & (sdf > 0)
    keep = [c for c in cov.columns if not (c.startswith("c") and c[1:].isdigit())]
    out = [
        F.when(covered, F.when((b["mode"] == 1) & (b["ink"] == k), num(1)).otherwise(num(0))).otherwise(F.col(f"c{k}")).alias(f"c{k}") for k in range(4)
    ]
    return joined.select(*keep, *out)


def marks(laid: DataFrame) -> DataFrame:
    """Crop marks, registration targets and layer labels that fit on the page: one row per mark.

    Needs image_id, layout, mode, page_size, placement, bleed_mm, print_target,
    crop_marks, reg_marks, layer_labels, ink_count.
    """
    lay = F.col("layout")
    cut, w, h = lay["cut"], lay["width"], lay["height"]
    px = lambda v: num(v / MM_PER_INCH) * lay["dpi"]
    rows = laid.where((F.col("mode") == "print") & (F.col("page_size") != "image"))
    bleed = F.col("bleed_mm") / MM_PER_INCH * lay["dpi"]
    gap = F.greatest(px(1.5), F.when(F.col("placement") == "fill", bleed + px(1)).otherwise(num(0)))
    rows = rows.withColumns({"_gap": gap, "_x0": cut["x"], "_y0": cut["y"], "_x1": cut["x"] + cut["w"], "_y1": cut["y"] + cut["h"]})
    gap = F.col("_gap")

    def shape(kind, x0, y0, x1, y1, layer=None) -> Column:
        return F.struct(F.lit(kind).alias("kind"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), F.lit(layer).cast("int").alias("layer"))

    def on_page(x: Column, y: Column) -> Column:
        return (x >= 0) & (y >= 0) & (x <= w) & (y <= h)

    shapes = []
    for xc, yc, dx, dy in (("_x0", "_y0", -1, -1), ("_x1", "_y0", 1, -1), ("_x0", "_y1", -1, 1), ("_x1", "_y1", 1, 1)):
        x, y = F.col(xc), F.col(yc)
        hx = (x + gap * dx, x + (gap + px(5)) * dx)
        vy = (y + gap * dy, y + (gap + px(5)) * dy)
        shapes.append(F.when(F.col("crop_marks") & on_page(F.least(*hx), y) & on_page(F.greatest(*hx), y), shape("line", hx[0], y, hx[1], y)))
        shapes.append(F.when(F.col("crop_marks") & on_page(x, F.least(*vy)) & on_page(x, F.greatest(*vy)), shape("line", x, vy[0], x, vy[1])))
    reach = px(3.75)
    cx, cy, d = (F.col("_x0") + F.col("_x1")) / 2, (F.col("_y0") + F.col("_y1")) / 2, gap + reach
    riso = F.col("print_target") == "riso"
    for x, y in ((cx, F.col("_y0") - d), (cx, F.col("_y1") + d), (F.col("_x0") - d, cy), (F.col("_x1") + d, cy)):
        fits = on_page(x - reach, y - reach) & on_page(x + reach, y + reach)
        shapes.append(F.when(F.col("reg_marks") & riso & fits, shape("target", x - reach, y - reach, x + reach, y + reach)))
    size = px(2.5)
    extra = F.when(F.col("reg_marks"), px(8.5)).otherwise(num(0))
    below, above = F.col("_y1") + gap + extra + size, F.col("_y0") - gap - extra
    base = F.when(below + size * 0.3 <= h, below).when(above - size >= 0, above)
    left = F.greatest(F.col("_x0"), gap)
    for k in range(4):
        label = shape("label", left, base - size, left, base, k)
        shapes.append(F.when(F.col("layer_labels") & riso & base.isNotNull() & (F.lit(k) < F.col("ink_count")), label))
    kept = F.filter(F.array(*shapes), lambda s: s.isNotNull())
    return rows.select("image_id", F.col("layout.dpi").alias("dpi"), F.explode(kept).alias("m")).select("image_id", "dpi", "m.*")


def mark_pixels(marked: DataFrame) -> DataFrame:
    """Page pixels that lines and targets cover: image_id, x, y.

    Lines are 0.2 mm wide, at least one pixel. A target is a cross and a ring.
    Each mark lists its own few thousand pixels, so stamping is an equi-join.
    """
    stroke = F.greatest(num(1), half_up(F.col("dpi") * (0.2 / MM_PER_INCH)))
    drawn = marked.where(F.col("kind") != "label").withColumn("_s", stroke)
    # Lines are padded across their direction only, so their ends stay square.
    line = F.col("kind") == "line"
    pad_x = F.when(line & (F.col("x0") == F.col("x1")), F.col("_s") / 2).otherwise(num(0))
    pad_y = F.when(line & (F.col("y0") == F.col("y1")), F.col("_s") / 2).otherwise(num(0))
    xs = F.sequence(F.floor(F.least("x0", "x1") - pad_x).cast("int"), F.ceil(F.greatest("x0", "x1") + pad_x).cast("int") - 1)
    ys = F.sequence(F.floor(F.least("y0", "y1") - pad_y).cast("int"), F.ceil(F.greatest("y0", "y1") + pad_y).cast("int") - 1)
    cells = drawn.select("*", F.explode(ys).alias("y")).select("*", F.explode(xs).alias("x"))
    mx, my = F.col("x") + 0.5, F.col("y") + 0.5
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    half = F.col("_s") / 2
    along_x = (F.abs(my - F.col("y0")) <= half) & (F.col("y0") == F.col("y1"))
    along_y = (F.abs(mx - F.col("x0")) <= half) & (F.col("x0") == F.col("x1"))
    away = F.sqrt((mx - cx) * (mx - cx) + (my - cy) * (my - cy))
    radius = (F.col("x1") - F.col("x0")) / 3
    target = (F.abs(mx - cx) <= half) | (F.abs(my - cy) <= half) | (F.abs(away - radius) <= half)
    hit = F.when(F.col("kind") == "line", along_x | along_y).otherwise(target)
    return cells.where(hit).select(*KEY).distinct()


def stamp(layers: DataFrame, covered: DataFrame, ink_count: int = 4) -> DataFrame:
    """Solid ink wherever a mark covers the pixel; other pixels keep their coverage."""
    keep = [c for c in layers.columns if c not in {f"c{k}" for k in range(ink_count)}]
    joined = layers.join(covered.select(*KEY, F.lit(True).alias("_hit")), KEY, "left")
    return joined.select(*keep, *[F.when(F.col("_hit"), num(1)).otherwise(F.col(f"c{k}")).alias(f"c{k}") for k in range(ink_count)])

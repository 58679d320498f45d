"""Point curves and lookup tables.

A curve is rows (keys, seq, x, y); a lookup table is rows (keys, i, v). All
functions keep the key columns, so one call serves one curve or millions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tintwell.functions.color import clamp01, constants, half_up, num

# Starting curves for an ink (x = lightness, y = density).
PRESETS = {
    "shadow": [(0, 1), (0.3, 0.85), (0.6, 0.15), (0.8, 0), (1, 0)],
    "midtone": [(0, 0.15), (0.25, 0.6), (0.5, 0.85), (0.75, 0.35), (1, 0)],
    "highlight": [(0, 0.25), (0.6, 0.35), (0.9, 0.1), (1, 0)],
    "full": [(0, 1), (1, 0)],
    "off": [(0, 0), (1, 0)],
}


def valid_curve(points: Column) -> Column:
    """At least two [x, y] pairs, every number finite and within 0..1."""

    def good(v: Column) -> Column:
        return v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v <= 1)

    pairs = F.forall(points, lambda p: (F.size(p) == 2) & F.forall(p, good))
    return F.coalesce((F.size(points) >= 2) & pairs, F.lit(False))


def normalize_curve(points: DataFrame, keys: list[str]) -> DataFrame:
    """Clamped points, one per x (the later one wins, also within 1e-6): keys, x, y.

    Keys whose points are all null (a curve without points) have the straight line.

    Equal x values fold in a partial aggregation first, so only distinct
    positions reach the window.
    """
    given = points.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    bare = points.groupBy(*keys).agg(F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)).alias("_n")).where("_n = 0")
    ends = F.array(*[F.struct(F.lit(at).alias("seq"), num(at).alias("x"), num(at).alias("y")) for at in (0, 1)])
    straight = bare.select(*keys, F.explode(ends).alias("_e")).select(*keys, "_e.x", "_e.y", "_e.seq")
    clamped = given.select(*keys, clamp01(F.col("x")).alias("x"), clamp01(F.col("y")).alias("y"), "seq").unionByName(straight)
    distinct = clamped.groupBy(*keys, "x").agg(F.max_by("y", "seq").alias("y"))
    following = F.lead("x").over(Window.partitionBy(*keys).orderBy("x"))
    return distinct.withColumn("_next", following).where(F.col("_next").isNull() | (F.col("_next") - F.col("x") >= 1e-6)).drop("_next")


def _tangents(points: Column) -> Column:
    """Monotone (Fritsch-Carlson) slopes at every point of one sorted curve.

    The limit runs left to right and each step changes the next slope, so it is
    an ordered fold over the few points of a curve.
    """
    n = F.size(points)
    slopes = F.transform(
        F.sequence(F.lit(0), n - 2),
        lambda i: (F.get(points, i + 1)["y"] - F.get(points, i)["y"]) / F.greatest(num(1e-9), F.get(points, i + 1)["x"] - F.get(points, i)["x"]),
    )

    def fold(d: Column) -> Column:
        def start(i: Column) -> Column:
            left, right = F.get(d, i - 1), F.get(d, i)
            inner = F.when(left * right <= 0, num(0)).otherwise((left + right) / 2)
            return F.when(i == 0, F.get(d, F.lit(0))).when(i == n - 1, F.get(d, n - 2)).otherwise(inner)

        def step(state: Column, i: Column) -> Column:
            slope = F.get(d, i)
            here, there = state["carry"], start(i + 1)
            a, b = here / slope, there / slope
            s = a * a + b * b
            flat, steep = slope == 0, s > 9
            t = F.lit(3.0) / F.sqrt(s)
            m0 = F.when(flat, num(0)).when(steep, t * a * slope).otherwise(here)
            m1 = F.when(flat, num(0)).when(steep, t * b * slope).otherwise(there)
            return F.struct(F.concat(state["out"], F.array(m0)).alias("out"), m1.alias("carry"))

        first = F.struct(F.array().cast("array<double>").alias("out"), start(F.lit(0)).alias("carry"))
        return F.aggregate(F.sequence(F.lit(0), n - 2), first, step, lambda state: F.concat(state["out"], F.array(state["carry"])))

    return F.get(F.transform(F.array(slopes), fold), F.lit(0))


def sample_curves(points: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Every curve sampled at `size` even positions: keys, i, v.

    Each segment generates the samples it holds, so no sample is joined to a
    segment and nothing is shuffled after the curve itself is gathered.
    """
    flat = normalize_curve(points, keys)
    curves = flat.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("p"))
    n = F.size("p")
    one = F.struct(num(0).alias("x"), F.get("p", F.lit(0))["y"].alias("y"))
    curves = curves.withColumn("m", F.when(n > 1, _tangents(F.col("p"))))
    head = F.struct(
        num(-1).alias("x0"), one["y"].alias("y0"), num(0).alias("m0"), F.get("p", F.lit(0))["x"].alias("x1"), one["y"].alias("y1"), num(0).alias("m1")
    )
    tail = F.struct(
        F.get("p", n - 1)["x"].alias("x0"), F.get("p", n - 1)["y"].alias("y0"), num(0).alias("m0"), num(2).alias("x1"), F.get("p", n - 1)["y"].alias("y1"), num(0).alias("m1")
    )
    inner = F.when(
        n > 1,
        F.transform(
            F.sequence(F.lit(0), n - 2),
            lambda i: F.struct(
                F.get("p", i)["x"].alias("x0"),
                F.get("p", i)["y"].alias("y0"),
                F.get("m", i).alias("m0"),
                F.get("p", i + 1)["x"].alias("x1"),
                F.get("p", i + 1)["y"].alias("y1"),
                F.get("m", i + 1).alias("m1"),
            ),
        ),
    ).otherwise(F.array().cast("array<struct<x0:double,y0:double,m0:double,x1:double,y1:double,m1:double>>"))
    last = size - 1
    segments = curves.select(*keys, F.explode(F.concat(F.array(head), inner, F.array(tail))).alias("s")).select(*keys, "s.*")
    low = F.greatest(F.lit(0), F.floor(F.col("x0") * last).cast("int"))
    high = F.least(F.lit(last), F.ceil(F.col("x1") * last).cast("int"))
    rows = segments.where(low <= high).select("*", F.explode(F.sequence(low, high)).alias("i"))
    x = F.col("i") / float(last)
    h = F.col("x1") - F.col("x0")
    rows = rows.where((x > F.col("x0")) & (x <= F.col("x1"))).withColumn("t", (x - F.col("x0")) / h).withColumn("h", h)
    t, t2 = F.col("t"), F.col("t") * F.col("t")
    t3 = t2 * t
    spline = (
        (t3 * 2 - t2 * 3 + 1) * F.col("y0") + (t3 - t2 * 2 + t) * F.col("h") * F.col("m0") + (t3 * -2 + t2 * 3) * F.col("y1") + (t3 - t2) * F.col("h") * F.col("m1")
    )
    return rows.select(*keys, "i", F.when((F.col("y0") == F.col("y1")) & (F.col("m0") == 0) & (F.col("m1") == 0), F.col("y0")).otherwise(clamp01(spline)).alias("v"))


def preset_points(rows: DataFrame, preset: str) -> DataFrame:
    """Control points of the named preset each row asks for: all columns, seq, x, y."""
    table = F.create_map(
        *[
            part
            for name, pts in PRESETS.items()
            for part in (F.lit(name), F.array(*[F.struct(F.lit(i).alias("seq"), num(x).alias("x"), num(y).alias("y")) for i, (x, y) in enumerate(pts)]))
        ]
    )
    return rows.select("*", F.explode(table[F.col(preset)]).alias("p")).select(*rows.columns, "p.*")


def levels(x: Column, black: Column, white: Column, mid: Column) -> Column:
    """Black and white points as fractions, midtone in -100..100."""
    w = F.greatest(black + 1 / 255, white)
    spread = clamp01((x - black) / (w - black))
    return F.pow(spread, num(1) / F.pow(num(2), mid / 50))


def tone_lut(settings: DataFrame, curves: DataFrame, keys: list[str]) -> DataFrame:
    """256-entry table of every tone setting: invert, levels, curve, density.

    `settings`: keys, black, white, mid, invert, density. `curves`: keys, i, v
    sampled at 1024. The result is quantised to bytes: keys, i, v (0..255).
    """
    entries = settings.select("*", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("i"))
    x = F.col("i") / 255.0
    x = F.when(F.col("invert"), num(1) - x).otherwise(x)
    spread = entries.withColumn("_at", half_up(levels(x, F.col("black"), F.col("white"), F.col("mid")) * 1023).cast("int"))
    table = curves.select(*keys, F.col("i").alias("_at"), F.col("v").alias("_v"))
    # Both sides have rows for every entry, which size estimates made before `explode` do not see; neither may be broadcast.
    joined = spread.join(table.hint("merge"), [*keys, "_at"])
    return joined.select(*keys, "i", half_up(F.least(num(1), F.col("_v") * F.col("density")) * 255).cast("int").alias("v"))


def as_arrays(lut: DataFrame, keys: list[str], out: str = "_table") -> DataFrame:
    """A table's entries (keys, i, v) as one array per key, so that pixels join once per key, not per entry."""
    entries = F.array_sort(F.collect_list(F.struct("i", "v")))  # a table has a fixed number of entries
    return lut.groupBy(*keys).agg(F.transform(entries, lambda e: e["v"]).alias(out))


def read_array(table: Column, x: Column, size: int = 256, each=lambda v: v) -> Column:
    """Entry at x (0..1) of an array of `size` entries, linear between two; `each` is applied to the two first."""
    pos = clamp01(x) * (size - 1)
    i = F.floor(pos).cast("int")
    a, b = each(F.get(table, i)), each(F.get(table, F.least(i + 1, F.lit(size - 1))))
    return a + (b - a) * (pos - i)


def apply_lut(df: DataFrame, lut: DataFrame, keys: list[str], value: str, out: str, size: int = 256) -> DataFrame:
    """Looks `value` (0..1) up in the table of the same keys, linear between entries; null where the keys have no table."""
    joined = df.join(as_arrays(lut, keys), keys, "left")
    return joined.withColumn(out, read_array(F.col("_table"), F.col(value), size)).drop("_table")


def lookup(values: list[float], x: Column) -> Column:
    """The same for one fixed table held as a constant array: no join at all."""
    last = len(values) - 1
    table = constants([float(v) for v in values])
    pos = clamp01(x) * last
    i = F.floor(pos).cast("int")
    a, b = F.get(table, i), F.get(table, F.least(i + 1, F.lit(last)))
    return a + (b - a) * (pos - i)


def _shape(t: Column, falloff: Column) -> Column:
    x = clamp01(t)
    return F.when(falloff == "hard", F.when(x < 0.5, num(0)).otherwise(num(1))).when(falloff == "linear", x).otherwise(x * x * (num(3) - x * 2))


def _band_density(b: Column, l: Column) -> Column:
    """Density that one band (a struct) gives a lightness."""
    lo, hi, step = b["lo"], b["hi"], b["posterize"]

    def edge(at: Column, width: Column) -> Column:
        return F.when(width > 0, _shape((l - (at - width / 2)) / width, b["falloff"])).otherwise(F.when(l >= at, num(1)).otherwise(num(0)))

    rise = F.when(b["band"] > 0, edge(lo, b["overlap_lo"])).otherwise(num(1))
    fall = F.when(b["band"] < b["n_bands"] - 1, num(1) - edge(hi, b["overlap_hi"])).otherwise(num(1))
    inside = F.when(hi > lo, clamp01((l - lo) / (hi - lo))).otherwise(num(0))
    shade = F.when(step > 0, F.ceil((num(1) - inside) * step) / F.greatest(step, F.lit(1))).otherwise(num(1) - inside)
    return F.greatest(num(0), rise * fall * F.when(b["fill"] == "gradient", shade).otherwise(num(1)))


_BAND = ("band", "n_bands", "lo", "hi", "overlap_lo", "overlap_hi", "falloff", "fill", "posterize")


def _band_densities(b: dict[str, np.ndarray]) -> np.ndarray:
    """Density that each band gives each of 256 lightnesses: a row per band."""
    l = np.arange(256) / 255.0
    f = {n: b[n][:, None] for n in _BAND}

    def edge(at: np.ndarray, width: np.ndarray) -> np.ndarray:
        x = np.clip((l - (at - width / 2)) / np.where(width > 0, width, 1), 0, 1)
        soft = np.where(f["falloff"] == "hard", x >= 0.5, np.where(f["falloff"] == "linear", x, x * x * (3 - x * 2)))
        return np.where(width > 0, soft, l >= at)

    rise = np.where(f["band"] > 0, edge(f["lo"], f["overlap_lo"]), 1.0)
    fall = np.where(f["band"] < f["n_bands"] - 1, 1 - edge(f["hi"], f["overlap_hi"]), 1.0)
    wide, step = f["hi"] > f["lo"], f["posterize"]
    inside = np.where(wide, np.clip((l - f["lo"]) / np.where(wide, f["hi"] - f["lo"], 1), 0, 1), 0.0)
    shade = np.where(step > 0, np.ceil((1 - inside) * step) / np.maximum(step, 1), 1 - inside)
    return np.maximum(0, rise * fall * np.where(f["fill"] == "gradient", shade, 1.0))


def band_tables(bands: DataFrame, keys: list[str], inks: int = 4) -> DataFrame:
    """One 256-entry density array per ink of each setup: keys, t0, t1, ... Setups of bare paper have zeros.

    `bands`: keys, band, n_bands, lo, hi, ink, overlap_lo, overlap_hi, falloff, fill, posterize. Bands without an ink
    stay paper. A setup's few bands meet in one row; the tables of all setups of a batch are computed together.
    """
    setups = bands.groupBy(*keys).agg(F.collect_list(F.struct("ink", *_BAND)).alias("_bands"))
    table = ArrayType(DoubleType(), False)
    schema = StructType([*[setups.schema[k] for k in keys], *[StructField(f"t{k}", table) for k in range(inks)]])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                lists = part.column("_bands")
                flat, setup = lists.flatten(), np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                column = lambda n: pc.struct_field(flat, n).to_numpy(zero_copy_only=False)  # noqa: E731, B023
                density, ink = _band_densities({n: column(n) for n in _BAND}), pc.fill_null(pc.struct_field(flat, "ink"), -1).to_numpy(zero_copy_only=False)
                arrays = [part.column(k) for k in keys]
                for k in range(inks):
                    top = np.zeros((part.num_rows, 256))
                    np.maximum.at(top, setup[ink == k], density[ink == k])
                    ends = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * 256)
                    arrays.append(pa.ListArray.from_arrays(ends, pa.array(top.ravel())).cast(arrow.field(f"t{k}").type))
                yield pa.record_batch(arrays, schema=arrow)

    return setups.mapInArrow(run, schema)


def bands_to_curves(bands: DataFrame, keys: list[str]) -> DataFrame:
    """Per-ink density tables of tone bands as rows: keys, ink, i, v, for the inks that a band uses."""
    setups = bands.where(F.col("ink").isNotNull()).groupBy(*keys, "ink").agg(F.collect_list(F.struct(*_BAND)).alias("_bands"))
    density = lambda i: F.aggregate("_bands", num(0), lambda top, b: F.greatest(top, _band_density(b, i / 255.0)))
    return setups.select(*keys, "ink", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(255)), density)).alias("i", "v"))


def resolve_band_inks(inks: DataFrame, bands: DataFrame, keys: list[str]) -> DataFrame:
    """Ink of each band: bands' columns plus `ink` (null = paper).

    `inks`: keys, ink, l (lightness). `bands`: keys, band, n_bands, choice
    ("auto", "paper" or a slot). Automatic bands take inks from the darkest up;
    with more bands than inks the lightest band stays paper.
    """
    order = Window.partitionBy(*keys).orderBy("l", "ink")
    ranked = inks.select(*keys, "ink", (F.row_number().over(order) - 1).alias("band"), F.count("*").over(Window.partitionBy(*keys)).alias("n_inks"))
    counts = ranked.groupBy(*keys).agg(F.first("n_inks").alias("n_inks"))
    auto = ranked.select(*keys, "band", F.col("ink").alias("auto_ink"))
    joined = bands.join(counts, keys).join(auto, [*keys, "band"], "left")
    paper_band = (F.col("n_bands") >= 2) & (F.col("n_bands") > F.col("n_inks")) & (F.col("band") == F.col("n_bands") - 1)
    slot = F.expr("try_cast(choice AS INT)")
    chosen = F.when(F.col("choice") == "auto", F.when(~paper_band, F.col("auto_ink"))).when((slot >= 0) & (slot < F.col("n_inks")), slot)
    return joined.select(*bands.columns, chosen.alias("ink"))


def simplify_curves(lut: DataFrame, keys: list[str], tolerance: float = 0.01, size: int = 256) -> DataFrame:
    """Few points that keep every table within `tolerance` (Douglas-Peucker): keys, i, x, y.

    `lut`: keys, i (0 to size - 1, all of them), v. A curve is one row, split in place: a fold takes the last segment off a
    stack, finds its worst point, and puts both halves back or leaves the segment as it is. Curves need no rounds and do
    not wait for each other.
    """
    last = size - 1
    tables = lut.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("_v"))
    ends = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    at = lambda i: F.get(F.col("_v"), i)

    def worst(s: Column) -> Column:
        """The inner point that is farthest off, of equal ones (within 1e-9) the earliest; null where none is too far."""
        ya, yb = at(s["a"]), at(s["b"])
        ax, bx = s["a"] / float(last), s["b"] / float(last)
        off = lambda i: F.abs(at(i) - (ya + (i / float(last) - ax) / (bx - ax) * (yb - ya)))
        inner = F.when(s["b"] - s["a"] > 1, F.sequence(s["a"] + 1, s["b"] - 1))
        far = F.filter(F.transform(inner, lambda i: F.struct(off(i).alias("d"), i.alias("i"))), lambda e: e["d"] > tolerance)
        return -F.array_max(F.transform(far, lambda e: F.struct(F.round(e["d"], 9).alias("d"), (-e["i"]).alias("m"))))["m"]

    def split(state: Column, _: Column) -> Column:
        top = F.element_at(state["open"], -1)
        rest = F.slice(state["open"], F.lit(1), F.size(state["open"]) - 1)
        halves = lambda i: F.concat(rest, F.array(ends(top["a"], i), ends(i, top["b"])))
        made = lambda left, kept: F.struct(left.alias("open"), kept.alias("kept"))
        # The worst point is read twice, so it is worked out once, as the only element of an array.
        taken = F.transform(F.array(worst(top)), lambda i: F.when(i.isNull(), made(rest, state["kept"])).otherwise(made(halves(i), F.concat(state["kept"], F.array(i)))))
        return F.when(F.size(state["open"]) == 0, state).otherwise(taken[0])

    start = F.struct(F.array(ends(F.lit(0), F.lit(last))).alias("open"), F.array(F.lit(0), F.lit(last)).alias("kept"))
    # Each kept point takes one step and adds one segment.
    kept = F.aggregate(F.sequence(F.lit(1), F.lit(2 * size)), start, split)["kept"]
    points = tables.select(*keys, "_v", F.explode(kept).alias("i"))
    thousandth = lambda c: half_up(c * 1000) / 1000.0
    return points.select(*keys, "i", thousandth(F.col("i") / float(last)).alias("x"), thousandth(at(F.col("i"))).alias("y"))


def move_linked(points: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """Moves the matching point of every linked curve: keys, i, x, y.

    `points`: keys, i (0-based position), x, y. `edits`: keys, from_x, dx, dy,
    endpoint ("first", "last" or null). Interior edits move the nearest interior
    point, kept 0.01 away from its neighbours.
    """
    w = Window.partitionBy(*keys)
    order = w.orderBy("i")
    rows = points.join(edits, keys).select(
        "*",
        F.max("i").over(w).alias("_last"),
        F.lag("x").over(order).alias("_left"),
        F.lead("x").over(order).alias("_right"),
    )
    interior = (F.col("i") > 0) & (F.col("i") < F.col("_last"))
    nearest = F.min(F.when(interior, F.struct(F.abs(F.col("x") - F.col("from_x")), F.col("i").alias("i")))).over(w)["i"]
    target = F.when(F.col("endpoint") == "first", F.lit(0)).when(F.col("endpoint") == "last", F.col("_last")).otherwise(nearest)
    rows = rows.withColumn("_target", target)
    hit = F.col("i") == F.col("_target")
    lo = F.when(F.col("i") > 0, F.col("_left") + 0.01).otherwise(num(0))
    hi = F.when(F.col("i") < F.col("_last"), F.col("_right") - 0.01).otherwise(num(1))
    moved = F.when(F.col("endpoint").isNotNull(), F.col("x")).otherwise(F.least(hi, F.greatest(lo, F.col("x") + F.col("dx"))))
    return rows.select(
        *keys,
        "i",
        F.when(hit, moved).otherwise(F.col("x")).alias("x"),
        F.when(hit, clamp01(F.col("y") + F.col("dy"))).otherwise(F.col("y")).alias("y"),
    )


def invert_lut(lut: DataFrame, keys: list[str], steps: int) -> DataFrame:
    """Position (0..1) at which a table of steps + 1 entries first reaches each of 256 targets: keys, i, v.

    The running maximum turns "first entry that reaches the target" into
    disjoint target ranges, and each entry generates the targets it owns.
    """
    order = Window.partitionBy(*keys).orderBy("i")
    # Entry 0 takes no part in the running maximum of the entries that follow it.
    first_max = F.max(F.when(F.col("i") >= 1, F.col("v"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    step = lut.select(*keys, "i", "v", F.lag("v").over(order).alias("c0"), first_max.alias("before")).where(F.col("i") >= 1)
    before = F.coalesce(F.col("before"), num(-1))
    low = F.greatest(F.lit(0), F.floor(before * 255).cast("int"))
    high = F.least(F.lit(255), F.ceil(F.col("v") * 255).cast("int"))
    owned = step.where(low <= high).select("*", F.explode(F.sequence(low, high)).alias("t"))
    target = F.col("t") / 255.0
    hit = owned.where((target > before) & (target <= F.col("v")))
    share = F.when(F.col("v") > F.col("c0"), clamp01((target - F.col("c0")) / (F.col("v") - F.col("c0")))).otherwise(num(0))
    found = hit.select(*keys, F.col("t").alias("i"), F.least(num(1), (F.col("i") - 1 + share) / float(steps)).alias("v"))
    # Targets nothing reaches sit at the end.
    peak = lut.where(F.col("i") >= 1).groupBy(*keys).agg(F.max("v").alias("peak"))
    beyond = peak.select("*", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("i")).where(F.col("i") / 255.0 > F.col("peak"))
    return found.unionByName(beyond.select(*keys, "i", num(1).alias("v")))

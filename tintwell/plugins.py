"""Split methods and halftones by name, open to user code.

A split method turns pixels (image_id, x, y, r, g, b bytes) into coverage
(image_id, x, y, c0..c3). A halftone turns output points and long coverage into
dots (image_id, x, y, ink, on). Prefer Column expressions; `mapInPandas` and
`mapInArrow` bodies work too, as only DataFrames pass between the parts.

A plug-in may have a life cycle. `prepare` builds tables that do not depend on
the pixels; they are written once as dimension tables, in a folder named by a
key of the settings they depend on, and read again by every later call with the
same key. `reach` says how far a result depends on neighbours, for tile margins.
A halftone that needs the whole image on a grid of dots gives `from_coverage`.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tintwell.functions import color as C
from tintwell.functions import hashing
from tintwell.operators import halftone as H
from tintwell.operators import match as MT
from tintwell.operators import spatial as SP
from tintwell.operators import split as E
from tintwell.session import ensure_checkpoint_dir

Params = dict[str, Any]
Tables = dict[str, DataFrame]
KEY = ["image_id", "x", "y"]
DRAFT, FINAL = "draft", "final"
#: Params that come from the palette; a method depends on them only if it says so.
PALETTE = ("table",)


@dataclass(frozen=True)
class SplitMethod:
    """`render(pixels, params)`, or `render(pixels, params, tables)` where there is something to prepare.

    `prepare(spark, params, quality)` gives named tables. They depend on `prepare_key(params)`, the method's own settings,
    and on `depends_on(params)`, what else goes into them, as ink colours; a method whose `depends_on` is None does not
    run again when those change. `needs_prepare(params)` may say that these settings need no tables.
    """

    name: str
    render: Callable[..., DataFrame]
    prepare: Callable[[SparkSession, Params, str], Tables] | None = None
    prepare_key: Callable[[Params], Any] = lambda params: None
    depends_on: Callable[[Params], Any] = lambda params: None
    needs_prepare: Callable[[Params], bool] = lambda params: True
    reach: Callable[[Params], float] = lambda params: 0.0


@dataclass(frozen=True)
class FromCoverage:
    """`cell(params)` is the output px of a grid cell; `build(grid, params)` turns coverage on the grid into dots on it."""

    cell: Callable[[Params], float]
    build: Callable[[DataFrame, Params], DataFrame]


@dataclass(frozen=True)
class Halftone:
    """`render(points, coverage, params)`, or with `tables` as for a split method; none where there is `from_coverage`.

    `prepare_key(params)` says what the prepared tables depend on. `reach(params)` is how far, in output px, a dot reaches
    from its centre.
    """

    name: str
    render: Callable[..., DataFrame] | None = None
    prepare: Callable[[SparkSession, Params, str], Tables] | None = None
    prepare_key: Callable[[Params], Any] = lambda params: None
    needs_prepare: Callable[[Params], bool] = lambda params: True
    reach: Callable[[Params], float] = lambda params: 1.5 * max([4.0, *params.get("sizes", [])])
    from_coverage: FromCoverage | None = None


SPLITS: dict[str, SplitMethod] = {}
HALFTONES: dict[str, Halftone] = {}


def split_method(name: str, **hooks):
    """Registers a render function under a name, with the hooks of `SplitMethod`."""

    def register(fn):
        SPLITS[name] = SplitMethod(name, fn, **hooks)
        return fn

    return register


def halftone(name: str, **hooks):
    """Registers a render function under a name, with the hooks of `Halftone`."""

    def register(fn):
        HALFTONES[name] = Halftone(name, fn, **hooks)
        return fn

    return register


def _found(name: str, plugins: dict, what: str):
    if name not in plugins:
        raise KeyError(f"no {what} named {name}; known: {sorted(plugins)}")
    return plugins[name]


def _plain(value: Any) -> Any:
    """Plain values for a key; a key cannot hold tables or functions."""
    if dataclasses.is_dataclass(value):
        return dataclasses.asdict(value)
    raise TypeError(f"{type(value).__name__} cannot be part of a key")


def table_key(plugin: SplitMethod | Halftone, params: Params, quality: str = FINAL) -> str:
    """Name of the tables a plug-in prepares for these settings."""
    parts = [type(plugin).__name__, plugin.name, quality, plugin.prepare_key(params), plugin.depends_on(params) if isinstance(plugin, SplitMethod) else None]
    return f"{plugin.name}-{hashlib.sha256(json.dumps(parts, sort_keys=True, default=_plain).encode()).hexdigest()[:24]}"


def render_key(name: str, params: Params) -> str:
    """Changes exactly when a split method has to run again for the same pixels: its settings, and what it depends on."""
    method = _found(name, SPLITS, "split method")
    other = method.depends_on(params)
    own = {k: v for k, v in params.items() if other is not None or k not in PALETTE}
    return hashlib.sha256(json.dumps([name, own, other], sort_keys=True, default=_plain).encode()).hexdigest()


def prepared(spark: SparkSession, plugin: SplitMethod | Halftone, params: Params, quality: str = FINAL, folder: str | None = None) -> Tables:
    """The plug-in's tables for these settings: built and written the first time, read from then on.

    `folder` holds the tables of all plug-ins; by default they live as long as the session, beside its checkpoints.
    """
    if folder is None:
        ensure_checkpoint_dir(spark)
        folder = f"{spark.sparkContext.getCheckpointDir()}/prepared"
    base = f"{folder}/{table_key(plugin, params, quality)}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = path(f"{base}/done")
    if not files.exists(done):
        for name, table in plugin.prepare(spark, params, quality).items():
            table.write.mode("overwrite").parquet(f"{base}/tables/{name}")
        files.create(done, True).close()
    names = [s.getPath().getName() for s in files.listStatus(path(f"{base}/tables"))]
    return {name: spark.read.parquet(f"{base}/tables/{name}") for name in names}


def _with_tables(plugin, params: Params) -> bool:
    return plugin.prepare is not None and plugin.needs_prepare(params)


def run_split(name: str, pixels: DataFrame, params: Params | None = None, quality: str = FINAL, folder: str | None = None) -> DataFrame:
    method, params = _found(name, SPLITS, "split method"), params or {}
    if method.prepare is None:
        return method.render(pixels, params)
    return method.render(pixels, params, prepared(pixels.sparkSession, method, params, quality, folder) if _with_tables(method, params) else {})


def preview_split(name: str, pixels: DataFrame, params: Params | None = None, folder: str | None = None) -> Iterator[tuple[str, DataFrame]]:
    """(quality, coverage): a quick draft first where the method prepares tables, then the final result."""
    if _with_tables(_found(name, SPLITS, "split method"), params or {}):
        yield DRAFT, run_split(name, pixels, params, DRAFT, folder)
    yield FINAL, run_split(name, pixels, params, FINAL, folder)


def run_halftone(name: str, points: DataFrame, coverage: DataFrame, params: Params | None = None, folder: str | None = None) -> DataFrame:
    method, params = _found(name, HALFTONES, "halftone"), params or {}
    if method.from_coverage is not None:
        return _from_grid(method.from_coverage, points, coverage, params)
    if method.prepare is None:
        return method.render(points, coverage, params)
    return method.render(points, coverage, params, prepared(points.sparkSession, method, params, FINAL, folder) if _with_tables(method, params) else {})


def _from_grid(whole: FromCoverage, points: DataFrame, coverage: DataFrame, params: Params) -> DataFrame:
    """Dots of every output point from those of its grid cell.

    `params`: width and height of the coverage, `scale` output px per coverage px. Without them coverage is the grid.
    """
    if "width" not in params:
        return whole.build(coverage, params).select(*KEY, "ink", "on")
    scale, cell = params.get("scale", 1.0), whole.cell(params)
    out_w, out_h = params["width"] * scale, params["height"] * scale
    sides = {"width": params["width"], "height": params["height"], "out_width": out_w, "out_height": out_h, "dot_size": cell, "min_dot": cell}
    # An ink of an image is one picture.
    layers = coverage.select(F.struct("image_id", "ink").alias("image_id"), "x", "y", "c")
    pictures = layers.select("image_id").distinct().select("image_id", *[F.lit(v).alias(n) for n, v in sides.items()])
    grid = H.coverage_grid(layers, pictures, ["c"]).select("image_id.image_id", "x", "y", "image_id.ink", "c")
    cells = whole.build(grid, params)
    # The grid has whole cells; an output px lies in the one that its share of the picture falls into.
    across, down = (max(1, int(side / cell + 0.999999999)) for side in (out_w, out_h))
    place = lambda c, n, side: F.least(F.lit(n - 1), F.floor((F.col(c) + 0.5) * n / float(side)).cast("int"))
    at = points.select(*KEY, "ink", place("x", across, out_w).alias("_gx"), place("y", down, out_h).alias("_gy"))
    lit = cells.select("image_id", "ink", F.col("x").alias("_gx"), F.col("y").alias("_gy"), "on")
    return at.join(lit, ["image_id", "ink", "_gx", "_gy"]).select(*KEY, "ink", "on")


def margin_of(split: str, split_params: Params, screen: str, screen_params: Params, sigma: float = 0.0) -> int:
    """Tile margin of a chain: a smoothing of the pixels, a split method and a halftone."""
    return SP.tile_margin(_found(screen, HALFTONES, "halftone").reach(screen_params), sigma, _found(split, SPLITS, "split method").reach(split_params))


def _srgb():
    return tuple(F.col(c) / 255.0 for c in "rgb")


def _covered(pixels: DataFrame, cov) -> DataFrame:
    return pixels.select(*KEY, *[c.alias(f"c{k}") for k, c in enumerate(cov)])


@split_method("tone_map")
def _tone_map(pixels: DataFrame, params: Params) -> DataFrame:
    return E.tone_map(pixels, params["curves"], params.get("keys", ["image_id"]), params.get("source", "luma")).select(*KEY, *E.coverage_columns())


@split_method("channel")
def _channel(pixels: DataFrame, params: Params) -> DataFrame:
    lin = C.rgb_to_linear((F.col("r"), F.col("g"), F.col("b")))
    values = E.channels(_srgb(), lin, params.get("space", "cmyk"), params.get("split", True), params.get("black", 0.5))
    if "matrix" in params:
        return _covered(pixels, E.mix_channels(values, params["matrix"], params.get("inks", 4)))
    routes = params.get("routes", [E.Route(k, k) for k in range(4)])
    return _covered(pixels, E.route(values, routes, params.get("blend", "add"), params.get("inks", 4)))


@split_method("selective")
def _selective(pixels: DataFrame, params: Params) -> DataFrame:
    h, s, l = C.hsl(_srgb())
    staged = pixels.select(*KEY, h.alias("_h"), s.alias("_s"), l.alias("_l"))
    cov = E.selective((F.col("_h"), F.col("_s"), F.col("_l")), params.get("ranges", []), params.get("amount", "saturation"), params.get("base"), params.get("inks", 4))
    return _covered(staged, cov)


def _match_size(params: Params, quality: str) -> int:
    return params.get("size") or (MT.DRAFT if quality == DRAFT else MT.FINAL)


def _match_tables(spark: SparkSession, params: Params, quality: str) -> Tables:
    size = _match_size(params, quality)
    lut = MT.ink_lut(spark, params["table"], params.get("options", MT.MatchOptions()), size)
    return {"lut": lut.withColumn("size", F.lit(size))}


@split_method("ink_matching", prepare=_match_tables, prepare_key=lambda params: [params.get("options", MT.MatchOptions()), params.get("size")], depends_on=lambda params: params["table"])
def _ink_matching(pixels: DataFrame, params: Params, tables: Tables) -> DataFrame:
    """Matches every distinct colour once through a prepared table, 17 cells a side as a draft and 33 as the final one."""
    lut = tables["lut"]
    size = lut.select("size").first()[0]
    names = [f"c{k}" for k in range(4)]
    fractions = lut.select("ri", "gi", "bi", *[(F.col(c) / 255.0).alias(c) for c in names])
    px = pixels.select(*KEY, *[c.alias(f"s{n}") for c, n in zip(_srgb(), "rgb")])
    return MT.apply_lut3(px, fractions, [], names, size).select(*KEY, *names)


def _detail_reach(params: Params) -> float:
    base = SPLITS[params.get("base", "channel")]
    return params.get("sigma", 1.0) * 2.5 + base.reach(params.get("base_params", {})) + 2


@split_method("detail", reach=_detail_reach, depends_on=lambda params: SPLITS[params.get("base", "channel")].depends_on(params.get("base_params", {})))
def _detail(pixels: DataFrame, params: Params) -> DataFrame:
    sigma = params.get("sigma", 1.0)
    lin = [c.alias(n) for c, n in zip(C.rgb_to_linear((F.col("r"), F.col("g"), F.col("b"))), ("lr", "lg", "lb"))]
    linear = pixels.select(*KEY, *lin)
    soft = SP.gaussian(linear, ["lr", "lg", "lb"], sigma)
    encode = lambda df: tuple(C.linear_to_srgb(F.col(c)) for c in ("lr", "lg", "lb"))
    luma = lambda df: df.select(*KEY, C.weighted(C.LUMA, encode(df)).alias("luma"))
    bytes_of = soft.select(*KEY, *[c.alias(n) for c, n in zip(C.linear_to_rgb((F.col("lr"), F.col("lg"), F.col("lb"))), "rgb")])
    base = run_split(params.get("base", "channel"), bytes_of, params.get("base_params", {}))
    sharp, blurred = luma(linear), luma(soft)
    mode = params.get("mode", "highpass")
    edges = SP.sobel(sharp, "luma") if mode == "edges" else None
    return E.detail_split(sharp, blurred, base, params.get("ink", 3), mode, params.get("contrast", 1.5), params.get("threshold", 0.05), edges)


@halftone("am", prepare=lambda spark, params, quality: {"ranks": H.rank_table(spark, params.get("shape", "round"))}, prepare_key=lambda params: params.get("shape", "round"))
def _am(points: DataFrame, coverage: DataFrame, params: Params, tables: Tables) -> DataFrame:
    return H.am_halftone(
        points, coverage, tables["ranks"], params.get("scale", 1.0), params["width"], params["height"], params.get("curve"), params.get("max_dot", 1.0), params.get("min_dot", 0.0), params.get("min_dot_mode", "drop")
    )


def _lattice(name: str, nearest_of):
    def prepare(spark: SparkSession, params: Params, quality: str) -> Tables:
        return {"thresholds": H.measured_table(spark, nearest_of(params), params.get("shape", "round"))}

    @halftone(name, prepare=prepare, prepare_key=lambda params: [params.get("shape", "round"), params.get("ratio", 1.0)])
    def run(points: DataFrame, coverage: DataFrame, params: Params, tables: Tables) -> DataFrame:
        return H.lattice_halftone(
            points, coverage, nearest_of(params), tables["thresholds"], params.get("shape", "round"), params.get("scale", 1.0), params["width"], params["height"], params.get("curve"), params.get("max_dot", 1.0), params.get("min_dot", 0.0), params.get("min_dot_mode", "drop")
        )


_lattice("hex", lambda params: H.nearest_hex)
_lattice("rings", lambda params: lambda x, y: H.nearest_ring(x, y, params.get("ratio", 1.0)))


def _spots(asked: DataFrame, centres, params: Params) -> DataFrame:
    """Threshold table of a point set, measured at hashed points: `asked` has k, x, y."""
    found = centres(asked)
    spot = F.round(H.spot_offset(params.get("shape", "round"), F.col("x"), F.col("y"), F.struct(F.col("cx").alias("x"), F.col("cy").alias("y"))), 9)
    return H.lattice_tables(found.select(F.lit(0).alias("k"), spot.alias("spot")), ["k"], "spot").select("i", "v")


def _hashed_points(spark: SparkSession, radius: float, samples: int = 65536) -> DataFrame:
    """k, x, y: points spread over a square around the origin; a constant number, whatever the data."""
    h = hashing.pcg(F.col("id") + 12345)
    at = lambda part: ((hashing.pcg_uniform(h, part) * 2 - 1) * radius).alias("xy"[part])
    return spark.range(samples).select(F.col("id").alias("k"), at(0), at(1))


def _centred(points: DataFrame, coverage: DataFrame, params: Params, centres, table: DataFrame) -> DataFrame:
    """Dots around centres found by a join. `centres(asked)` takes image_id, ox, oy, ink, x, y (lattice units) and adds cx, cy.

    `table` (i, v) is the threshold table of the point set.
    """
    at = H.on_lattice(points)
    asked = at.select("image_id", F.col("x").alias("ox"), F.col("y").alias("oy"), "ink", F.col("_qx").alias("x"), F.col("_qy").alias("y"))
    found = centres(asked).select("image_id", F.col("ox").alias("x"), F.col("oy").alias("y"), "ink", F.struct(F.col("cx").alias("x"), F.col("cy").alias("y")).alias("_c"))
    return H.lattice_dots(
        at.join(found, [*KEY, "ink"]), coverage, table, params.get("shape", "round"), params.get("scale", 1.0), params["width"], params["height"],
        params.get("curve"), params.get("max_dot", 1.0), params.get("min_dot", 0.0), params.get("min_dot_mode", "drop"),
    )


_ASKED = ["image_id", "ox", "oy", "ink"]


def _nudged(field: DataFrame, size: int, amount: float, keys: list[str]):
    return lambda asked: H.nearest_jittered(asked, field, [], keys, size, amount).withColumnsRenamed({"px": "cx", "py": "cy"})


def _noise_tables(spark: SparkSession, params: Params, quality: str) -> Tables:
    size = params.get("tile_size", 64)
    seeds = spark.createDataFrame([(params.get("seed", 1),)], "sid long")
    field = H.noise_field(seeds, "sid", params.get("kind", "blue"), size, params.get("cluster", 4.0)).drop("sid")
    asked = _hashed_points(spark, size / 2)
    return {"field": field, "thresholds": _spots(asked, _nudged(field, size, params.get("amount", 1.0), ["k", "x", "y"]), params)}


@halftone(
    "noise",
    prepare=_noise_tables,
    prepare_key=lambda params: [params.get(k) for k in ("seed", "kind", "tile_size", "cluster", "amount", "shape")],
    needs_prepare=lambda params: "field" not in params,
)
def _noise(points: DataFrame, coverage: DataFrame, params: Params, tables: Tables) -> DataFrame:
    """Grid dots nudged by a wrapping noise field of `kind`, `seed` and `tile_size`, by `amount`.

    Own fields: `field` (tx, ty, nx, ny) with `table` (i, v), the threshold table of its dots.
    """
    field, table = tables.get("field", params.get("field")), tables.get("thresholds", params.get("table"))
    return _centred(points, coverage, params, _nudged(field, params.get("tile_size", 64), params.get("amount", 1.0), _ASKED), table)


def _on_sites(sites: DataFrame, keys: list[str]):
    places = sites.select("site", F.col("sx").alias("cx"), F.col("sy").alias("cy"))
    return lambda asked: H.nearest_site(asked.select(*dict.fromkeys([*keys, "x", "y"])), sites, keys).join(places, "site")


def _spiral_tables(spark: SparkSession, params: Params, quality: str) -> Tables:
    count = params.get("points", 4096)
    x, y = H.spiral_point(F.col("id"), params.get("divergence", 137.5))
    sites = spark.range(count).select(F.col("id").alias("site"), x.alias("sx"), y.alias("sy"))
    # The square inside the disc that the points fill.
    asked = _hashed_points(spark, max(1.0, (count / 3.1416) ** 0.5 * 0.7 - 2))
    return {"sites": sites, "thresholds": _spots(asked, _on_sites(sites, ["k", "x", "y"]), params)}


@halftone(
    "spiral",
    prepare=_spiral_tables,
    prepare_key=lambda params: [params.get("points"), params.get("divergence"), params.get("shape")],
    needs_prepare=lambda params: "sites" not in params,
)
def _spiral(points: DataFrame, coverage: DataFrame, params: Params, tables: Tables) -> DataFrame:
    """Dots of a sunflower spiral of `points` and `divergence` around the origin of the lattice.

    Own point sets: `sites` (site, sx, sy), in lattice units, with `table` (i, v), the threshold table of their dots.
    """
    return _centred(points, coverage, params, _on_sites(tables.get("sites", params.get("sites")), _ASKED), tables.get("thresholds", params.get("table")))


@halftone("stipple")
def _stipple(points: DataFrame, coverage: DataFrame, params: Params) -> DataFrame:
    """One pixel for each point whose rank the tone reaches: `stipple_points` (image_id, i, x, y, rank16), `thresholds`."""
    inks = coverage.select("image_id", "ink").distinct()
    asked = params["stipple_points"].join(inks, "image_id").withColumn("image_id", F.struct("image_id", "ink"))
    cells = coverage.select(F.struct("image_id", "ink").alias("image_id"), "x", "y", "c")
    picked = H.ranked_select(asked, cells, params["thresholds"])
    lit = picked.select("image_id.image_id", "image_id.ink", F.floor("x").cast("int").alias("x"), F.floor("y").cast("int").alias("y"), F.lit(True).alias("_lit")).distinct()
    return coverage.join(lit, [*KEY, "ink"], "left").select(*KEY, "ink", F.coalesce("_lit", F.lit(False)).alias("on"))


@halftone("field")
def _field(points: DataFrame, coverage: DataFrame, params: Params) -> DataFrame:
    """Ink where a wrapping pattern field is high enough: `field` (tx, ty, v), `tile_size`, `texels` per output pixel."""
    texels = params.get("texels", 1.0)
    asked = points.select("image_id", F.col("x").alias("ox"), F.col("y").alias("oy"), "ink", ((F.col("x") + 0.5) * texels).alias("x"), ((F.col("y") + 0.5) * texels).alias("y"))
    f = H.sample_field(asked, params["field"], [], _ASKED, params["tile_size"])
    f = f.select("image_id", F.col("ox").alias("x"), F.col("oy").alias("y"), "ink", "f")
    at = f.withColumns({"sx": F.col("x") + 0.5, "sy": F.col("y") + 0.5})
    toned = H.at_sample(at, coverage, params.get("scale", 1.0), params["width"], params["height"]).withColumn("_k", F.lit(0))
    table = H.area_tables(params["field"].select(F.lit(0).alias("_k"), "v"), ["_k"], "v")
    return H.threshold_test(toned, table, ["_k"], "c", "f", above=True).select(*KEY, "ink", "on")


@halftone("ordered")
def _ordered(points: DataFrame, coverage: DataFrame, params: Params) -> DataFrame:
    """Threshold tile, one dot per coverage cell."""
    out = H.ordered_dither(
        coverage, params["tile"], params.get("tile_keys", []), params["tile_size"], params.get("low", 0.0), params.get("high", 1.0), params.get("offsets"), params.get("noise", 0.0), params.get("seed", 1)
    )
    return out.select(*KEY, "ink", "on")


def _carried(grid: DataFrame, params: Params) -> DataFrame:
    """Error carried along each row of the grid."""
    cells = grid.select(*KEY, "ink", F.floor(F.col("c") * 255 + 0.5).cast("int").alias("_b"))
    order = H.serpentine(F.col("x"), F.col("y")) if params.get("serpentine") else F.col("x")
    out = H.carry_round(cells, ["image_id", "ink", "y"], order, "_b")
    return out.select(*KEY, "ink", (F.col("on") == 1).alias("on"))


HALFTONES["carry"] = Halftone("carry", from_coverage=FromCoverage(lambda params: max(1.0, params.get("dot_size", 1.0), params.get("min_dot", 0.0)), _carried))

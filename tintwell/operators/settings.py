"""Settings: a registry of definitions, values conformed to it, presets and reports.

Values are long rows (project, section, key, slot, value) with the value as JSON
text, so one table holds numbers, choices, switches, colours, text and curves.
The registry is a small dimension built from `Setting` records.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tintwell.operators.curves import valid_curve
from tintwell.session import constant_rows, cut_lineage

SLOTS = 4
NAME_LIMIT = 60
# Sections a preset leaves alone, and settings kept when one is applied.
NOT_IN_LOOK = ["upload", "presets", "export"]
KEPT = ["adjust.turn", "adjust.straighten", "adjust.cropX", "adjust.cropY", "adjust.cropW", "adjust.cropH", "layers.solo", "layers.mute"]
# Upload limits.
ACCEPTED = ["image/jpeg", "image/png", "image/webp"]
EXTENSIONS = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp"}
MAX_BYTES = 100 * 1024 * 1024
MAX_PIXELS = 50_000_000


@dataclass(frozen=True)
class Setting:
    """One definition. `default` is a Python value; `modes` and `when` limit visibility."""

    section: str
    key: str
    kind: str
    label: str
    default: object
    low: float | None = None
    high: float | None = None
    step: float | None = None
    unit: str | None = None
    options: tuple[tuple[str, str], ...] = ()
    max_length: int | None = None
    per_ink: bool = False
    slot_defaults: tuple = ()
    stage: str | None = None
    stage_given: bool = False
    section_stage: str | None = None
    modes: tuple[str, ...] = ()
    hidden: bool = False
    #: Visible only if this other setting holds one of these values: (section, key, values).
    when: tuple[str, str, tuple[str, ...]] | None = None


REGISTRY_SCHEMA = """section string, key string, kind string, label string, position int, default string, low double, high double, step double,
unit string, options array<string>, labels array<string>, max_length int, per_ink boolean, slots array<string>, stage string, stage_given boolean,
section_stage string, modes array<string>, hidden boolean, when_section string, when_key string, when_values array<string>"""


def as_json(kind: str, value: object) -> str:
    """JSON text of a default; numbers are always written as doubles."""
    return json.dumps(float(value) if kind == "number" else value)


def registry_table(spark: SparkSession, settings: list[Setting]) -> DataFrame:
    rows = []
    for i, s in enumerate(settings):
        own = [s.slot_defaults[k] if k < len(s.slot_defaults) and s.slot_defaults[k] is not None else s.default for k in range(SLOTS)]
        slots = [as_json(s.kind, v) for v in own] if s.per_ink else None
        when = s.when or (None, None, ())
        low, high, step = (None if v is None else float(v) for v in (s.low, s.high, s.step))
        rows.append(
            (s.section, s.key, s.kind, s.label, i, as_json(s.kind, s.default), low, high, step, s.unit, [o for o, _ in s.options], [l for _, l in s.options],
             s.max_length, s.per_ink, slots, s.stage, s.stage_given, s.section_stage, list(s.modes), s.hidden, when[0], when[1], list(when[2]))
        )
    return spark.createDataFrame(rows, REGISTRY_SCHEMA)


def defaults(registry: DataFrame) -> DataFrame:
    """Every setting's default, one row per ink slot where it is per ink: section, key, slot, value."""
    slot = F.when(F.col("per_ink"), F.sequence(F.lit(0), F.lit(SLOTS - 1))).otherwise(F.array(F.lit(0)))
    rows = registry.select("section", "key", "default", "slots", F.explode(slot).alias("slot"))
    return rows.select("section", "key", "slot", F.coalesce(F.get("slots", F.col("slot")), F.col("default")).alias("value"))


def _json_string(text: Column) -> Column:
    """Contents of a JSON string, null for any other JSON value."""
    return F.when(text.rlike('^".*"$'), F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "v string")["v"])


def _as_number(text: Column) -> Column:
    """Number a value stands for: JSON numbers, numeric strings, switches as 1 and 0; null otherwise."""
    plain = F.when(text.rlike("^-?[0-9]+(\\.[0-9]+)?([eE][+-]?[0-9]+)?$"), text.try_cast("double"))
    inner = F.trim(_json_string(text))
    quoted = F.when(inner == "", F.lit(0.0)).when(inner.rlike("^[+-]?[0-9]*\\.?[0-9]+([eE][+-]?[0-9]+)?$"), inner.try_cast("double"))
    return F.when(text == "true", F.lit(1.0)).when(text.isin("false", "null"), F.lit(0.0)).otherwise(F.coalesce(plain, quoted))


def conform(settings: DataFrame, registry: DataFrame, projects: DataFrame) -> DataFrame:
    """Every registered setting of every project, made valid: project, section, key, slot, value (JSON text).

    Unknown settings fall away, missing ones take their default, numbers are
    clamped, and anything of the wrong shape becomes the default. The registry is
    a few hundred rows at most, checked before it becomes a constant; values join
    on project, section, key and slot.
    """
    slot = F.when(F.col("per_ink"), F.sequence(F.lit(0), F.lit(SLOTS - 1))).otherwise(F.array(F.lit(0)))
    wanted = registry.select("section", "key", "kind", "default", "low", "high", "options", "max_length", "slots", F.explode(slot).alias("slot"))
    # Each project lists the settings it must have, from a constant.
    grid = projects.select("project").distinct().select("project", F.explode(constant_rows(wanted)).alias("_d")).select("project", "_d.*")
    found = grid.join(settings.select("project", "section", "key", "slot", F.col("value").alias("_given")), ["project", "section", "key", "slot"], "left")
    v, d = F.col("_given"), F.col("default")
    start = F.coalesce(F.get("slots", F.col("slot")), d)
    number, text = _as_number(v), _json_string(v)
    quote = lambda c: F.to_json(F.struct(c.alias("v")))
    bare_json = lambda c: F.regexp_extract(quote(c), '^\\{"v":(.*)\\}$', 1)
    clamped = F.least(F.col("high"), F.greatest(F.col("low"), number))
    seed = F.abs(number)
    points = F.from_json(v, "array<array<double>>")
    made = (
        F.when(v.isNull(), start)
        .when(F.col("kind") == "number", F.when(number.isNotNull(), bare_json(clamped)).otherwise(d))
        .when(F.col("kind") == "seed", F.when(number.isNotNull(), (F.floor(seed) % 2147483648).cast("string")).otherwise(d))
        .when(F.col("kind") == "select", F.when(F.array_contains("options", text), v).otherwise(d))
        .when(F.col("kind") == "toggle", F.when(v.isin("true", "false"), v).otherwise(d))
        .when(F.col("kind") == "color", F.when(text.rlike("^#[0-9a-fA-F]{6}$"), F.lower(v)).otherwise(d))
        .when(F.col("kind") == "text", F.when(text.isNotNull(), bare_json(F.when(F.col("max_length").isNotNull(), F.substring(text, F.lit(1), F.col("max_length"))).otherwise(text))).otherwise(d))
        .when(F.col("kind") == "curve", F.when(valid_curve(points), v).otherwise(start))
    )
    return found.select("project", "section", "key", "slot", made.alias("value"))


def default_settings(projects: DataFrame, registry: DataFrame) -> DataFrame:
    """Default settings of every project: project, section, key, slot, value."""
    rows = projects.select("project").distinct().select("project", F.explode(constant_rows(defaults(registry))).alias("_d"))
    return rows.select("project", "_d.*")


# ---- presets ----


def read_presets(texts: DataFrame, app: str) -> DataFrame:
    """Preset files from JSON text: texts' columns plus reason, version, name, saved_at, settings.

    Rows that are not presets keep a reason and nulls, so bad files can be set
    apart without a second pass.
    """
    v = F.try_parse_json("text")
    part = lambda path: F.try_variant_get("_v", path, "variant")
    kind = lambda path: F.schema_of_variant(part(path))
    rows = texts.withColumn("_v", v)
    number = F.coalesce(kind("$.version"), F.lit("")).rlike("^(BIGINT|DOUBLE|DECIMAL.*|FLOAT)$")
    string = lambda path: F.when(kind(path) == "STRING", F.try_variant_get("_v", path, "string"))
    named = F.trim(string("$.name"))
    bad = (
        F.when(F.col("_v").isNull(), "not json")
        .when(~F.coalesce(string("$.app") == app, F.lit(False)) | ~F.coalesce(string("$.kind") == "preset", F.lit(False)), "not a preset")
        .when(~F.coalesce(kind("$.settings").startswith("OBJECT"), F.lit(False)), "not a preset")
    )
    rows = rows.withColumn("reason", bad)
    good = F.col("reason").isNull()
    return rows.select(
        *texts.columns,
        "reason",
        F.when(good, F.when(number, F.try_variant_get("_v", "$.version", "double")).otherwise(F.lit(1.0))).alias("version"),
        F.when(good, F.when(F.length(named) > 0, F.substring(named, 1, NAME_LIMIT)).otherwise("Preset")).alias("name"),
        F.when(good, F.coalesce(string("$.savedAt"), F.lit(""))).alias("saved_at"),
        F.when(good, F.to_json(part("$.settings"))).alias("settings"),
    )


def upsert_presets(current: DataFrame, new: DataFrame) -> DataFrame:
    """Presets by case-insensitive name, the newest version of each; sort by name when reading."""
    both = current.unionByName(new)
    row = F.struct(*[F.col(c) for c in both.columns])
    return both.groupBy(F.lower("name").alias("_k")).agg(F.max_by(row, "saved_at").alias("_r")).select("_r.*")


def stored_presets(spark: SparkSession, path: str) -> DataFrame:
    """Presets of a store that `upsert_stored` keeps."""
    return spark.read.parquet(path).drop("of", "bucket")


def upsert_stored(new: DataFrame, path: str, buckets: int = 64) -> list[int]:
    """Upserts presets into the store at `path`, a new one or one of as many buckets, and returns the buckets written.

    Names fall into buckets by a hash of their lower case. Only buckets that get a preset are read and written; the files
    of all others stay as they are. Buckets are replaced as a whole at the end, from rows checkpointed before.
    """
    spark = new.sparkSession
    bucket = F.pmod(F.xxhash64(F.lower("name")), F.lit(buckets)).cast("int")
    arriving = cut_lineage(new)
    touched = sorted(r[0] for r in arriving.select(bucket.alias("bucket")).distinct().collect())  # at most `buckets`
    if not touched:
        return []
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        stored = spark.read.parquet(path)
        if not stored.where(F.col("of") != buckets).isEmpty():
            raise ValueError(f"the store at {path} has another number of buckets than {buckets}")
        arriving = upsert_presets(stored.where(F.col("bucket").isin(touched)).select(new.columns), arriving)
    else:
        arriving = upsert_presets(arriving.limit(0), arriving)
    placed = cut_lineage(arriving.withColumns({"of": F.lit(buckets), "bucket": bucket}).repartition("bucket"))
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("of", "bucket").parquet(path)
    return touched


def delete_presets(current: DataFrame, names: DataFrame) -> DataFrame:
    """Presets without the exactly named ones."""
    return current.join(names.select("name"), "name", "left_anti")


def look_rows(settings: DataFrame) -> DataFrame:
    """Settings that belong to a look: without page, upload and photo geometry."""
    spark = settings.sparkSession
    kept = spark.createDataFrame([tuple(k.split(".")) for k in KEPT], "section string, key string")
    return settings.where(~F.col("section").isin(NOT_IN_LOOK)).join(F.broadcast(kept), ["section", "key"], "left_anti")


def look_of(settings: DataFrame) -> DataFrame:
    """The look of every project as JSON, keyed "section.key": project, look. Settings per ink are arrays, slot by slot."""
    slots = F.array_sort(F.collect_list(F.struct("slot", "value")))  # at most SLOTS
    rows = look_rows(settings).groupBy("project", F.concat_ws(".", "section", "key").alias("k")).agg(slots.alias("s"))
    listed = F.concat(F.lit("["), F.array_join(F.transform("s", lambda e: e["value"]), ","), F.lit("]"))
    rows = rows.select("project", "k", F.when(F.size("s") > 1, listed).otherwise(F.col("s")[0]["value"]).alias("value"))
    packed = rows.groupBy("project").agg(F.array_sort(F.collect_list(F.struct("k", "value"))).alias("kv"))  # one entry per registered setting
    pairs = F.transform("kv", lambda e: F.concat(F.lit('"'), e["k"], F.lit('":'), e["value"]))
    return packed.select("project", F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")).alias("look"))


# ---- ink slots ----


def permute_inks(settings: DataFrame, order: list[int], keys: DataFrame | None = None) -> DataFrame:
    """Reorders every per-ink setting: new slot i takes what old slot order[i] held.

    `settings` rows with `per_ink` move; `keys` (project) limits the projects.
    """
    moved = F.get(F.array(*[F.lit(order.index(s)) for s in range(len(order))]), F.col("slot"))
    if keys is None:
        return settings.withColumn("slot", F.when(F.col("per_ink"), moved).otherwise(F.col("slot")))
    rows = settings.join(keys.select("project", F.lit(True).alias("_own")).distinct(), "project", "left")
    return rows.withColumn("slot", F.when(F.col("per_ink") & F.col("_own"), moved).otherwise(F.col("slot"))).drop("_own")


def reset_slot(settings: DataFrame, registry: DataFrame, slot: int) -> DataFrame:
    """Per-ink settings with one slot back at its default."""
    base = defaults(registry).where(F.col("slot") == slot).select("section", "key", F.col("value").alias("_d"))
    joined = settings.join(base, ["section", "key"], "left")
    hit = F.col("per_ink") & (F.col("slot") == slot)
    return joined.withColumn("value", F.when(hit, F.col("_d")).otherwise(F.col("value"))).drop("_d")


def add_ink(settings: DataFrame, registry: DataFrame, counts: DataFrame, colours: DataFrame, color_key: tuple[str, str]) -> DataFrame:
    """Settings after one more ink: the slot after the last goes back to its defaults and takes the next colour.

    `counts`: project, inks (in use so far); projects with all slots in use stay as they are. `colours`: project, hex
    (`palette.next_ink`); `color_key` is the section and key of the ink colours. `per_ink` rows only are touched.
    """
    base = defaults(registry).select("section", "key", "slot", F.col("value").alias("_d"))
    rows = settings.join(counts.select("project", "inks"), "project", "left").join(base, ["section", "key", "slot"], "left")
    rows = rows.join(colours.select("project", F.col("hex").alias("_hex")), "project", "left")
    hit = F.col("per_ink") & (F.col("slot") == F.col("inks")) & (F.col("inks") < SLOTS)
    colour = (F.col("section") == color_key[0]) & (F.col("key") == color_key[1]) & F.col("_hex").isNotNull()
    new = F.when(colour, F.concat(F.lit('"'), F.col("_hex"), F.lit('"'))).otherwise(F.col("_d"))
    return rows.select(*[F.when(F.coalesce(hit, F.lit(False)), new).otherwise(F.col(c)).alias(c) if c == "value" else F.col(c) for c in settings.columns])


def remove_order(slot: int) -> list[int]:
    """Order that moves a removed ink behind the others."""
    return [s for s in range(SLOTS) if s != slot] + [slot]


def move_order(slot: int, direction: int, count: int) -> list[int]:
    """Order that moves an ink one place in print order (unchanged at the ends)."""
    order = list(range(SLOTS))
    other = slot + direction
    if 0 <= other < count:
        order[slot], order[other] = order[other], order[slot]
    return order


def convert_length(v: Column, to_mm: Column, step: float) -> Column:
    """A length in the other unit, rounded to its step and to hundredths."""
    raw = F.when(to_mm, v * 25.4).otherwise(v / 25.4)
    return F.floor(F.floor(raw / step + 0.5) * step * 100 + 0.5) / 100.0


def convert_units(pages: DataFrame) -> DataFrame:
    """Page lengths in the other unit: project, units, margin, bleed, page_width, page_height, image_width.

    Margins step by 0.5 mm or 0.01 in, the rest by 0.01.
    """
    to_mm = F.col("units") == "in"
    edge = lambda c: F.when(to_mm, convert_length(F.col(c), F.lit(True), 0.5)).otherwise(convert_length(F.col(c), F.lit(False), 0.01))
    return pages.select(
        "project",
        F.when(to_mm, "mm").otherwise("in").alias("units"),
        *[edge(c).alias(c) for c in ("margin", "bleed")],
        *[convert_length(F.col(c), to_mm, 0.01).alias(c) for c in ("page_width", "page_height", "image_width")],
    )


# ---- visibility and reports ----


def visible(settings: DataFrame, registry: DataFrame) -> DataFrame:
    """Settings shown in a project's mode and for its other values: settings' columns plus the definition.

    `settings`: project, section, key, slot, value (conformed). A rule is one
    more value of the same project, so it is a join on (project, section, key).
    """
    rules = registry.select("section", "key", "kind", "label", "position", "step", "unit", "options", "labels", "per_ink", "slots", "default", "modes", "hidden", "when_section", "when_key", "when_values")
    joined = settings.join(rules, ["section", "key"])
    mode = settings.where((F.col("section") == "upload") & (F.col("key") == "mode")).select("project", F.col("value").alias("_mode"))
    other = settings.where(F.col("slot") == 0).select("project", F.col("section").alias("when_section"), F.col("key").alias("when_key"), F.col("value").alias("_when"))
    joined = joined.join(mode, "project", "left").join(other, ["project", "when_section", "when_key"], "left")
    bare = lambda c: F.regexp_replace(c, '^"|"$', "")
    in_mode = (F.size("modes") == 0) | F.array_contains("modes", bare(F.col("_mode")))
    ruled = F.col("when_key").isNull() | F.coalesce(F.array_contains("when_values", bare(F.col("_when"))), F.lit(False))
    return joined.where(in_mode & ruled).drop("_mode", "_when", "modes", "when_section", "when_key", "when_values")


def _fixed(v: Column, digits: int) -> Column:
    scaled = F.floor(F.abs(v) * 10**digits + 0.5) / float(10**digits)
    return F.format_string(f"%.{digits}f", F.when(v < 0, -scaled).otherwise(scaled))


def format_value() -> Column:
    """Text of one slot's value for a report, by kind."""
    v = F.col("value")
    n = v.try_cast("double")
    digits = F.when(F.col("step") < 0.1, _fixed(n, 2)).when(F.col("step") < 1, _fixed(n, 1)).otherwise(_fixed(n, 0))
    unit = F.when(F.col("unit").isNull(), "").when(F.col("unit").isin("%", "°"), F.col("unit")).otherwise(F.concat(F.lit(" "), F.col("unit")))
    bare = F.regexp_replace(v, '^"|"$', "")
    at = F.array_position("options", bare).cast("int")
    points = F.from_json(v, "array<array<double>>")
    end = lambda i: F.get(F.get(points, F.lit(i)), F.lit(0)) == F.get(F.get(points, F.lit(i)), F.lit(1))
    curve = F.when((F.size(points) == 2) & end(0) & end(1), "straight").otherwise(F.concat(F.size(points).cast("string"), F.lit("-point curve")))
    return (
        F.when(F.col("kind") == "number", F.concat(digits, unit))
        .when(F.col("kind") == "select", F.when(at > 0, F.get("labels", at - 1)).otherwise(bare))
        .when(F.col("kind") == "toggle", F.when(v == "true", "on").otherwise("off"))
        .when(F.col("kind") == "curve", curve)
        .otherwise(bare)
    )


def manifest(settings: DataFrame, registry: DataFrame, ink_counts: DataFrame) -> DataFrame:
    """"Label: value" lines of every project in registry order: project, position, line.

    Per-ink values are joined by " / " for the inks in use. Layer options appear
    only where a slot differs from its default. `ink_counts`: project, inks.
    """
    shown = visible(settings, registry).join(ink_counts, "project")
    layer = (F.col("section") == "layers") & F.col("per_ink")
    shown = shown.where((layer | ~F.col("hidden")) & (F.col("kind") != "seed") & (~F.col("per_ink") | (F.col("slot") < F.col("inks"))))
    start = F.coalesce(F.get("slots", F.col("slot")), F.col("default"))
    number = F.col("value").try_cast("double")
    same = F.when(number.isNotNull(), number == start.try_cast("double")).otherwise(F.col("value") == start)
    rows = shown.select("project", "position", "label", "slot", format_value().alias("text"), (layer & same).alias("_plain"))
    lines = rows.groupBy("project", "position", "label").agg(F.array_sort(F.collect_list(F.struct("slot", "text"))).alias("s"), F.bool_and("_plain").alias("_plain"))  # four slots
    text = F.array_join(F.transform("s", lambda e: e["text"]), " / ")
    return lines.where(~F.col("_plain")).select("project", "position", F.concat_ws(": ", "label", text).alias("line"))


# ---- uploads ----


def ingest_gate(files: DataFrame) -> DataFrame:
    """Adds `reason` (null = accepted): the first upload rule a file breaks.

    Needs file_name, mime, bytes, width, height (null where it could not be decoded).
    """
    ext = F.lower(F.element_at(F.split("file_name", "\\."), -1))
    known = F.create_map(*[F.lit(p) for kv in EXTENSIONS.items() for p in kv])
    kind = F.when(F.length(F.coalesce("mime", F.lit(""))) > 0, F.lower("mime")).otherwise(F.coalesce(known[ext], F.lit("")))
    reason = (
        F.when(kind.isin("image/heic", "image/heif") | F.lower("file_name").rlike("\\.hei[cf]$"), "heic")
        .when(~kind.isin(ACCEPTED), "type")
        .when(F.col("bytes") > MAX_BYTES, "bytes")
        .when(F.col("width").isNull() | F.col("height").isNull(), "damaged")
        .when(F.col("width").cast("bigint") * F.col("height") > MAX_PIXELS, "pixels")
    )
    return files.withColumn("reason", reason)


def split_gate(gated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted files and rejects."""
    return gated.where(F.col("reason").isNull()).drop("reason"), gated.where(F.col("reason").isNotNull())


# ---- layer names ----


def file_base(name: Column) -> Column:
    """Project name made safe for a file name."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(name, '[\\\\/:*?"<>|\\x00-\\x1f]+', "-"), "\\s+", " "))
    return F.when(F.length(clean) > 0, clean).otherwise("Untitled")


def layer_name(name: Column, order: Column, hex_col: Column) -> Column:
    """`Project_01_0078BF`: print order, then the ink."""
    return F.concat_ws("_", file_base(name), F.lpad(order.cast("string"), 2, "0"), F.upper(F.regexp_replace(hex_col, "#", "")))


def number_slots(inks: DataFrame, keys: list[str]) -> DataFrame:
    """Adds print_order (from 1) to at most four inks per palette."""
    return inks.withColumn("print_order", F.row_number().over(Window.partitionBy(*keys).orderBy("ink")))

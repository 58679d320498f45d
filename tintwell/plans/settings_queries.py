"""Settings, presets and uploads over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tintwell.operators import curves as D
from tintwell.operators import settings as A
from tintwell.operators.palette import NEW_INKS, next_ink
from tintwell.operators.settings import Setting
from tintwell.plans.curve_queries import byte_at, byte_sql, vectors
from tintwell.plans.registry import query
from tintwell.session import ensure_checkpoint_dir, read_table
from tintwell.sources import bridge as B
from tintwell.sources import images as IO


@query(
    "a1_ingest_gate",
    B.ctes("files")
    + r""", k AS (SELECT *, CASE WHEN mime <> '' THEN lower(mime) ELSE CASE lower(regexp_extract(file_name, '[^.]*$')) WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg' WHEN 'png' THEN 'image/png' WHEN 'webp' THEN 'image/webp' ELSE '' END END AS kind FROM files)
SELECT image_id, file_name, CASE WHEN kind IN ('image/heic', 'image/heif') OR regexp_matches(lower(file_name), '\.hei[cf]$') THEN 'heic' WHEN kind NOT IN ('image/jpeg', 'image/png', 'image/webp') THEN 'type'
  WHEN bytes > 104857600 THEN 'bytes' WHEN width::BIGINT * height > 50000000 THEN 'pixels' END AS reason FROM k""",
)
def a1_ingest_gate(spark, folder):
    return A.ingest_gate(B.files(spark, folder)).select("image_id", "file_name", "reason")


PRESET_TEXT = """texts AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'not json ' || event_id
  WHEN 1 THEN '{"app":"tintwell","kind":"preset","version":' || (1 + event_id % 5) || ',"name":"  Look ' || user_id || '  ","savedAt":"2024","settings":{"adjust":{"v":' || event_id || '}}}'
  WHEN 2 THEN '{"app":"other","kind":"preset","settings":{}}' WHEN 3 THEN '{"app":"tintwell","kind":"preset","version":"2","name":7,"settings":{}}' WHEN 4 THEN '{"app":"tintwell","kind":"preset","settings":[1]}'
  WHEN 5 THEN '{"app":"tintwell","kind":"preset","name":"' || repeat('long name ', 9) || '","settings":{"a":{"k":' || user_id || '}}}' WHEN 6 THEN '[' || event_id || ']' ELSE '{"app":"tintwell","kind":"preset","name":"   ","version":1.5,"settings":{}}' END AS text FROM events)"""


def preset_texts(spark, folder):
    e = read_table(spark, folder, "events").select("event_id", "user_id")
    i, u = F.col("event_id"), F.col("user_id").cast("string")
    s = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    text = (
        F.when(i % 8 == 0, s("not json ", i.cast("string")))
        .when(i % 8 == 1, s('{"app":"tintwell","kind":"preset","version":', (i % 5 + 1).cast("string"), ',"name":"  Look ', u, '  ","savedAt":"2024","settings":{"adjust":{"v":', i.cast("string"), "}}}"))
        .when(i % 8 == 2, '{"app":"other","kind":"preset","settings":{}}')
        .when(i % 8 == 3, '{"app":"tintwell","kind":"preset","version":"2","name":7,"settings":{}}')
        .when(i % 8 == 4, '{"app":"tintwell","kind":"preset","settings":[1]}')
        .when(i % 8 == 5, s('{"app":"tintwell","kind":"preset","name":"' + "long name " * 9 + '","settings":{"a":{"k":', u, "}}}"))
        .when(i % 8 == 6, s("[", i.cast("string"), "]"))
        .otherwise('{"app":"tintwell","kind":"preset","name":"   ","version":1.5,"settings":{}}')
    )
    return e.select("event_id", text.alias("text"))


@query(
    "a3_read_presets",
    f"""WITH {PRESET_TEXT}, j AS (SELECT event_id, CASE WHEN json_valid(text) THEN text::JSON END AS j FROM texts),
r AS (SELECT *, CASE WHEN j IS NULL THEN 'not json' WHEN coalesce(j->>'$.app', '') <> 'tintwell' OR coalesce(j->>'$.kind', '') <> 'preset' OR coalesce(json_type(j, '$.settings'), '') <> 'OBJECT' THEN 'not a preset' END AS reason FROM j)
SELECT event_id, reason, CASE WHEN reason IS NULL THEN CASE WHEN json_type(j, '$.version') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(j->>'$.version' AS DOUBLE) ELSE 1 END END AS version,
  CASE WHEN reason IS NULL THEN CASE WHEN json_type(j, '$.name') = 'VARCHAR' AND trim(j->>'$.name') <> '' THEN substr(trim(j->>'$.name'), 1, 60) ELSE 'Preset' END END AS name,
  CASE WHEN reason IS NULL THEN coalesce(j->>'$.savedAt', '') END AS saved_at, CASE WHEN reason IS NULL THEN CAST(j->'$.settings' AS VARCHAR) END AS settings FROM r""",
)
def a3_read_presets(spark, folder):
    return A.read_presets(preset_texts(spark, folder), "tintwell").select("event_id", "reason", "version", "name", "saved_at", "settings")


# A registry with every kind of setting, plain and per ink.
CHOICES = (("opt0", "First"), ("opt1", "Second"), ("opt2", "Third"))
REGISTRY = [
    Setting("upload", "mode", "select", "Mode", "digital", options=(("digital", "Digital"), ("print", "Print"))),
    Setting("adjust", "blackPoint", "number", "Black point", 0, 0, 100, 0.5, "%"),
    Setting("adjust", "midtone", "number", "Midtone", 0, -20, 20, 1),
    Setting("adjust", "turn", "number", "Rotation", 0, 0, 270, 90, "°", hidden=True),
    Setting("layers", "density", "number", "Density", 100, 0, 200, 1, "%", per_ink=True, hidden=True),
    Setting("layers", "invert", "toggle", "Invert", False, per_ink=True, hidden=True),
    Setting("halftone", "type", "select", "Type", "opt1", options=CHOICES),
    Setting("halftone", "minDot", "number", "Minimum dot", 1.5, 0, 8, 0.5, "px", per_ink=True, slot_defaults=(1, 2, None, 4), when=("halftone", "type", ("opt0", "opt2"))),
    Setting("palette", "inkColor", "color", "Ink", "#000000", per_ink=True, slot_defaults=("#0078bf", "#ff48b0", "#ffe800", "#000000")),
    Setting("palette", "paper", "color", "Paper", "#f6f3ec"),
    Setting("specks", "seed", "seed", "Seed", 1),
    Setting("upload", "projectName", "text", "Name", "Untitled", max_length=4),
    Setting("export", "bleed", "number", "Bleed", 0, 0, 10, 0.05, "mm", modes=("print",)),
    Setting("border", "fade", "toggle", "Fade edges", False),
    Setting("border", "fadeColor", "select", "Fade to", "opt0", options=CHOICES, when=("border", "fade", ("true",))),
]
N = len(REGISTRY)
_KEYS = [(s.section, s.key, s.per_ink) for s in REGISTRY]
_list = lambda vals: "[" + ", ".join("'" + str(v) + "'" for v in vals) + "]"
RAW = f"""raw AS (SELECT user_id AS project, event_id AS seq, k, CAST(k % {N} AS INTEGER) AS r, CASE WHEN ({_list(str(p).lower() for _, _, p in _KEYS)})[k % {N} + 1] = 'true' THEN CAST(k // {N} % 4 AS INTEGER) ELSE 0 END AS slot,
  CASE event_id % 6 WHEN 0 THEN CAST(CAST(floor(value) AS INTEGER) AS VARCHAR) WHEN 1 THEN '"' || k || '"' WHEN 2 THEN CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END WHEN 3 THEN '"#A' || lpad(CAST(k * 997 % 100000 AS VARCHAR), 5, '0') || '"'
    WHEN 4 THEN '"opt' || (k % 4) || '"' ELSE '-' || k || '.5' END AS value FROM (SELECT *, CAST(props->>'$.k' AS INTEGER) AS k FROM events) e),
given AS (SELECT project, r, slot, arg_max(value, seq) AS value FROM raw GROUP BY ALL)"""


def raw_settings(spark, folder):
    c = B.changes(spark, folder)
    k, i = F.col("key"), F.col("seq")
    pick = lambda at, cast: F.get(F.array(*[F.lit(row[at]) for row in _KEYS]), k % N)
    value = (
        F.when(i % 6 == 0, F.floor("value").cast("int").cast("string"))
        .when(i % 6 == 1, F.concat(F.lit('"'), k.cast("string"), F.lit('"')))
        .when(i % 6 == 2, F.when(k % 2 == 0, "true").otherwise("false"))
        .when(i % 6 == 3, F.concat(F.lit('"#A'), F.lpad((k * 997 % 100000).cast("string"), 5, "0"), F.lit('"')))
        .when(i % 6 == 4, F.concat(F.lit('"opt'), (k % 4).cast("string"), F.lit('"')))
        .otherwise(F.concat(F.lit("-"), k.cast("string"), F.lit(".5")))
    )
    slot = F.when(pick(2, None), F.floor(k / N).cast("int") % 4).otherwise(0)
    rows = c.select("project", "seq", pick(0, None).alias("section"), pick(1, None).alias("key"), slot.alias("slot"), value.alias("value"))
    return rows.groupBy("project", "section", "key", "slot").agg(F.max_by("value", "seq").alias("value"))


def registry(spark):
    return A.registry_table(spark, REGISTRY)


def conformed(spark, folder):
    raw = raw_settings(spark, folder)
    return A.conform(raw, registry(spark), raw.select("project"))


def _q(kind: str, v) -> str:
    return "'" + A.as_json(kind, v) + "'"


def _reg_values() -> str:
    rows = []
    for r, s in enumerate(REGISTRY):
        for slot in range(4 if s.per_ink else 1):
            own = s.slot_defaults[slot] if slot < len(s.slot_defaults) and s.slot_defaults[slot] is not None else s.default
            opts = "[" + ", ".join(f"'{o}'" for o, _ in s.options) + "]::VARCHAR[]"
            rows.append(f"({r}, '{s.section}', '{s.key}', {slot}, '{s.kind}', {_q(s.kind, s.default)}, {_q(s.kind, own)}, {s.low if s.low is not None else 'NULL'}, {s.high if s.high is not None else 'NULL'}, {opts}, {s.max_length or 'NULL'})")
    return "reg(r, section, key, slot, kind, def, own, low, high, opts, cut) AS (VALUES " + ", ".join(rows) + ")"


_NUM = "CASE WHEN value IN ('true') THEN 1 WHEN value = 'false' THEN 0 WHEN value LIKE '\"%' THEN TRY_CAST(trim(value, '\"') AS DOUBLE) ELSE TRY_CAST(value AS DOUBLE) END"
CONFORMED = f"""{RAW}, {_reg_values()}, grid AS (SELECT project, reg.*, g.value, {_NUM.replace('value', 'g.value')} AS num, CASE WHEN g.value LIKE '"%' THEN trim(g.value, '"') END AS txt FROM (SELECT DISTINCT user_id AS project FROM events) p CROSS JOIN reg LEFT JOIN given g USING (project, r, slot)),
conf AS (SELECT project, r, section, key, slot, kind, own, def, CASE WHEN value IS NULL THEN own WHEN kind = 'number' THEN CASE WHEN num IS NULL THEN def ELSE CAST(least(high::DOUBLE, greatest(low::DOUBLE, num)) AS VARCHAR) END
  WHEN kind = 'seed' THEN CASE WHEN num IS NULL THEN def ELSE CAST(CAST(floor(abs(num)) AS BIGINT) % 2147483648 AS VARCHAR) END WHEN kind = 'select' THEN CASE WHEN list_contains(opts, txt) THEN value ELSE def END
  WHEN kind = 'toggle' THEN CASE WHEN value IN ('true', 'false') THEN value ELSE def END WHEN kind = 'color' THEN CASE WHEN regexp_full_match(txt, '#[0-9a-fA-F]{{6}}') THEN lower(value) ELSE def END
  ELSE CASE WHEN txt IS NOT NULL THEN '"' || substr(txt, 1, cut) || '"' ELSE def END END AS value FROM grid)"""


@query("a4_conform", f"WITH {CONFORMED} SELECT project, section, key, slot, value FROM conf")
def a4_conform(spark, folder):
    return conformed(spark, folder)


_BAD = f"CASE vec_id % 6 WHEN 0 THEN [list_value(0.0::DOUBLE, {byte_sql(0)} / 255.0::DOUBLE)] WHEN 1 THEN [list_value(0.0::DOUBLE, 0.5), list_value(1.0, {byte_sql(1)} / 200.0::DOUBLE)] WHEN 2 THEN [list_value(0.0::DOUBLE, 0.5), list_value(0.5::DOUBLE)] ELSE [list_value(0.0::DOUBLE, {byte_sql(0)} / 255.0::DOUBLE), list_value(1.0::DOUBLE, {byte_sql(1)} / 255.0::DOUBLE)] END"


@query(
    "a5_valid_curve",
    f"WITH c AS (SELECT vec_id AS curve_id, {_BAD} AS pts FROM embeddings) SELECT curve_id, len(pts) >= 2 AND len(list_filter(pts, lambda p: len(p) <> 2 OR len(list_filter(p, lambda v: v < 0 OR v > 1)) > 0)) = 0 AS valid FROM c",
)
def a5_valid_curve(spark, folder):
    i, z = F.col("curve_id") % 6, F.lit(0.0)
    a, b = byte_at(0) / 255.0, byte_at(1) / 255.0
    pts = (
        F.when(i == 0, F.array(F.array(z, a)))
        .when(i == 1, F.array(F.array(z, F.lit(0.5)), F.array(F.lit(1.0), byte_at(1) / 200.0)))
        .when(i == 2, F.array(F.array(z, F.lit(0.5)), F.array(F.lit(0.5))))
        .otherwise(F.array(F.array(z, a), F.array(F.lit(1.0), b)))
    )
    return vectors(spark, folder).select("curve_id", D.valid_curve(pts).alias("valid"))


PRESETS = """cur AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'Look ' ELSE 'LOOK ' END || lang || n_chars % 97 AS name, doc_id AS saved_at, n_chars AS body FROM documents WHERE doc_id % 3 > 0),
new AS (SELECT 'look ' || lang || n_chars % 97 AS name, doc_id + 1000000 AS saved_at, n_chars AS body FROM documents WHERE doc_id % 3 = 0)"""


def presets(spark, folder):
    d = read_table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    name = lambda start: F.concat(start, F.col("lang"), (F.col("n_chars") % 97).cast("string"))
    cur = d.where(F.col("doc_id") % 3 > 0).select(name(F.when(F.col("doc_id") % 2 == 0, "Look ").otherwise("LOOK ")).alias("name"), F.col("doc_id").alias("saved_at"), F.col("n_chars").alias("body"))
    new = d.where(F.col("doc_id") % 3 == 0).select(name(F.lit("look ")).alias("name"), (F.col("doc_id") + 1000000).alias("saved_at"), F.col("n_chars").alias("body"))
    return cur, new


@query(
    "a6_upsert_presets",
    f"WITH {PRESETS}, u AS (SELECT * FROM (SELECT * FROM cur UNION ALL SELECT * FROM new) t QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY saved_at DESC) = 1) SELECT name, saved_at, body FROM u WHERE name NOT IN (SELECT 'look ' || lang || 5 FROM documents) ORDER BY name",
)
def a6_upsert_presets(spark, folder):
    cur, new = presets(spark, folder)
    gone = read_table(spark, folder, "documents").select(F.concat(F.lit("look "), F.col("lang"), F.lit("5")).alias("name")).distinct()
    return A.delete_presets(A.upsert_presets(cur, new), gone).select("name", "saved_at", "body").orderBy("name")


@query(
    "a6_stored_upsert",
    f"WITH {PRESETS}, u AS (SELECT * FROM (SELECT * FROM cur UNION ALL SELECT * FROM new) t QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY saved_at DESC) = 1) SELECT name, saved_at, body FROM u",
)
def a6_stored_upsert(spark, folder):
    """The presets stored, then the new ones upserted into their buckets."""
    cur, new = presets(spark, folder)
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/presets-{uuid.uuid4().hex}"
    for rows in (cur, new):
        A.upsert_stored(rows, path, 16)
    return A.stored_presets(spark, path)


@query(
    "a7_look_of",
    f"""WITH {CONFORMED}, lk AS (SELECT project, section || '.' || key AS k, CASE WHEN count(*) > 1 THEN '[' || string_agg(value, ',' ORDER BY slot) || ']' ELSE max(value) END AS value FROM conf WHERE section NOT IN ('upload', 'presets', 'export') AND section || '.' || key NOT IN ('adjust.turn', 'adjust.straighten', 'layers.solo', 'layers.mute') GROUP BY project, section, key)
SELECT project, '{{' || string_agg('"' || k || '":' || value, ',' ORDER BY k) || '}}' AS look FROM lk GROUP BY project""",
)
def a7_look_of(spark, folder):
    return A.look_of(conformed(spark, folder))


@query(
    "a8_layer_names",
    B.ctes("palettes")
    + r""", n AS (SELECT p_partkey AS palette_id, p_name || ' : ' || p_brand || ' /x  y' AS nm FROM part) SELECT palette_id, ink + 1 AS print_order,
  trim(regexp_replace(regexp_replace(nm, '[\\/:*?"<>|]+', '-', 'g'), '\s+', ' ', 'g')) || '_0' || (ink + 1) || '_' || upper(substr(hex, 2)) AS layer FROM palettes JOIN n USING (palette_id)""",
)
def a8_layer_names(spark, folder):
    p = read_table(spark, folder, "part").select(F.col("p_partkey").alias("palette_id"), F.concat("p_name", F.lit(" : "), "p_brand", F.lit(" /x  y")).alias("nm"))
    inks = A.number_slots(B.palettes(spark, folder), ["palette_id"]).join(p, "palette_id")
    return inks.select("palette_id", "print_order", A.layer_name(F.col("nm"), F.col("print_order"), F.col("hex")).alias("layer"))


_INKS = [(0, "#0078bf"), (1, "#ff48b0"), (2, "#ffe800"), (3, "#000000")]


@query(
    "a8_layer_rows",
    B.ctes("coverage")
    + ", l AS (" + " UNION ALL ".join(f"SELECT image_id, {k + 1} AS print_order, 'Two - names_0{k + 1}_{h[1:].upper()}' AS layer, x, y, c{k} AS c FROM coverage" for k, h in _INKS)
    + ") SELECT image_id, print_order, layer, x, y, CAST(255 - floor(c * 255 + 0.5) AS INTEGER) AS v FROM l",
)
def a8_layer_rows(spark, folder):
    """The layers of every coverage image, written in print order and read back."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/layers-{uuid.uuid4().hex}"
    IO.write_layers(IO.layer_rows(B.coverage(spark, folder), spark.createDataFrame(_INKS, "ink int, hex string"), "Two / names"), path)
    return IO.read_layers(spark, path)


def _case(col: str, table: dict) -> str:
    return f"CASE {col} " + " ".join(f"WHEN {k} THEN {v}" for k, v in table.items()) + " END"


_STEP = {r: s.step for r, s in enumerate(REGISTRY) if s.kind == "number"}
_DIG = {r: (2 if st < 0.1 else 1 if st < 1 else 0) for r, st in _STEP.items()}
_UNIT = {r: "'" + (s.unit if s.unit in ("%", "°") else " " + s.unit if s.unit else "") + "'" for r, s in enumerate(REGISTRY) if s.kind == "number"}
_LABEL = {r: f"'{s.label}'" for r, s in enumerate(REGISTRY)}
_HIDDEN = [r for r, s in enumerate(REGISTRY) if s.hidden and not (s.section == "layers" and s.per_ink)]
_WHEN = {r: next(i for i, o in enumerate(REGISTRY) if (o.section, o.key) == s.when[:2]) for r, s in enumerate(REGISTRY) if s.when}
VISIBLE = f"""{CONFORMED}, vis AS (SELECT c.* FROM conf c LEFT JOIN conf m ON m.project = c.project AND m.r = 0 LEFT JOIN conf w ON w.project = c.project AND w.slot = 0 AND w.r = {_case('c.r', _WHEN)}
  WHERE (c.section <> 'export' OR m.value = '"print"') AND (c.r NOT IN ({', '.join(map(str, _WHEN))}) OR (c.key = 'minDot' AND w.value IN ('"opt0"', '"opt2"')) OR (c.key = 'fadeColor' AND w.value = 'true')))"""


@query("a11_visible", f"WITH {VISIBLE} SELECT project, section, key, slot FROM vis")
def a11_visible(spark, folder):
    return A.visible(conformed(spark, folder), registry(spark)).select("project", "section", "key", "slot")


_FIX = {0: "printf('%.0f', {0})", 1: "printf('%.1f', {0})", 2: "printf('%.2f', {0})"}
_VAL = "(CASE WHEN n < 0 THEN -floor(abs(n) * {0} + 0.5) / {0}.0::DOUBLE ELSE floor(n * {0} + 0.5) / {0}.0::DOUBLE END)"
_TEXT = f"""CASE kind WHEN 'number' THEN CASE {_case('r', _DIG)} WHEN 0 THEN printf('%.0f', {_VAL.format(1)}) WHEN 1 THEN printf('%.1f', {_VAL.format(10)}) ELSE printf('%.2f', {_VAL.format(100)}) END || {_case('r', _UNIT)}
  WHEN 'toggle' THEN CASE value WHEN 'true' THEN 'on' ELSE 'off' END WHEN 'select' THEN CASE value WHEN '"opt0"' THEN 'First' WHEN '"opt1"' THEN 'Second' WHEN '"opt2"' THEN 'Third' WHEN '"print"' THEN 'Print' ELSE 'Digital' END ELSE trim(value, '"') END"""


@query(
    "a10_manifest",
    f"""WITH {VISIBLE}, tx AS (SELECT *, TRY_CAST(value AS DOUBLE) AS n FROM vis WHERE r NOT IN ({', '.join(map(str, _HIDDEN))}) AND kind <> 'seed' AND slot < 3), fm AS (SELECT *, {_TEXT} AS t, section = 'layers' AND coalesce(n = TRY_CAST(own AS DOUBLE), value = own) AS plain FROM tx),
ln AS (SELECT project, r, string_agg(t, ' / ' ORDER BY slot) AS t, bool_and(plain) AS plain FROM fm GROUP BY project, r)
SELECT project, r AS position, {_case('r', _LABEL)} || ': ' || t AS line FROM ln WHERE NOT plain""",
)
def a10_manifest(spark, folder):
    values = conformed(spark, folder)
    counts = values.select("project").distinct().withColumn("inks", F.lit(3))
    return A.manifest(values, registry(spark), counts)


@query("a12_defaults", f"WITH {_reg_values()} SELECT user_id AS project, section, key, slot, own AS value FROM (SELECT DISTINCT user_id FROM events) p, reg")
def a12_defaults(spark, folder):
    """Default settings for every project of the log."""
    return A.default_settings(read_table(spark, folder, "events").select(F.col("user_id").alias("project")), registry(spark))


_PER = ", ".join(str(r) for r, s in enumerate(REGISTRY) if s.per_ink)


@query(
    "a13_permute_inks",
    f"""WITH {CONFORMED}, mv AS (SELECT project, section, key, r, CASE WHEN r IN ({_PER}) THEN CASE slot WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END ELSE slot END AS slot, value FROM conf)
SELECT m.project, m.section, m.key, m.slot, CASE WHEN m.r IN ({_PER}) AND m.slot = 3 THEN reg.own ELSE m.value END AS value FROM mv m JOIN reg ON reg.r = m.r AND reg.slot = m.slot""",
)
def a13_permute_inks(spark, folder):
    """Removes the second ink of every project, then resets the freed slot."""
    reg = registry(spark)
    rows = conformed(spark, folder).join(F.broadcast(reg.select("section", "key", "per_ink")), ["section", "key"])
    moved = A.permute_inks(rows, A.remove_order(1))
    return A.reset_slot(moved, reg, 3).select("project", "section", "key", "slot", "value")


_NEW = ", ".join(f"({i}, '{h}')" for i, h in enumerate(NEW_INKS))
_COLOR = next(r for r, s in enumerate(REGISTRY) if s.key == "inkColor")


@query(
    "a13_add_ink",
    f"""WITH {CONFORMED}, n(k, hex) AS (VALUES {_NEW}), cnt AS (SELECT DISTINCT project, CAST(1 + project % 4 AS INTEGER) AS inks FROM conf),
col AS (SELECT cnt.project, arg_min(n.hex, n.k) AS hex FROM cnt, n WHERE NOT EXISTS (SELECT 1 FROM conf u WHERE u.project = cnt.project AND u.r = {_COLOR} AND u.slot < cnt.inks AND trim(u.value, '"') = n.hex) GROUP BY 1)
SELECT m.project, m.section, m.key, m.slot, CASE WHEN m.r IN ({_PER}) AND m.slot = inks AND inks < 4 THEN CASE WHEN m.r = {_COLOR} THEN '"' || hex || '"' ELSE m.own END ELSE m.value END AS value
FROM conf m JOIN cnt ON cnt.project = m.project JOIN col ON col.project = m.project""",
)
def a13_add_ink(spark, folder):
    """One more ink for every project that has room for it, in the first colour it does not use yet."""
    reg = registry(spark)
    rows = conformed(spark, folder).join(F.broadcast(reg.select("section", "key", "per_ink")), ["section", "key"])
    counts = rows.select("project").distinct().withColumn("inks", (F.col("project") % 4 + 1).cast("int"))
    used = rows.where("section = 'palette' AND key = 'inkColor'").join(counts, "project").where("slot < inks")
    colours = next_ink(used.select("project", F.trim(F.col("value"), F.lit('"')).alias("hex")), ["project"])
    return A.add_ink(rows, reg, counts, colours, ("palette", "inkColor")).select("project", "section", "key", "slot", "value")


def _conv(c: str, step: str) -> str:
    return f"floor(floor((CASE WHEN units = 'in' THEN {c} * 25.4::DOUBLE ELSE {c} / 25.4::DOUBLE END) / {step}::DOUBLE + 0.5) * {step}::DOUBLE * 100 + 0.5) / 100.0::DOUBLE"


@query(
    "a14_convert_units",
    f"""WITH p AS (SELECT o_orderkey AS project, CASE WHEN o_orderkey % 2 = 0 THEN 'in' ELSE 'mm' END AS units, (o_orderkey % 40) / 7.0::DOUBLE AS margin, (o_orderkey % 13) / 9.0::DOUBLE AS bleed, o_totalprice / 900 AS page_width, o_totalprice / 1100 AS page_height, o_totalprice / 2100 AS image_width FROM orders)
SELECT project, CASE WHEN units = 'in' THEN 'mm' ELSE 'in' END AS units, {", ".join(f"CASE WHEN units = 'in' THEN {_conv(c, '0.5')} ELSE {_conv(c, '0.01')} END AS {c}" for c in ("margin", "bleed"))}, {", ".join(f"{_conv(c, '0.01')} AS {c}" for c in ("page_width", "page_height", "image_width"))} FROM p""",
)
def a14_convert_units(spark, folder):
    o = read_table(spark, folder, "orders")
    k, t = F.col("o_orderkey"), F.col("o_totalprice")
    p = o.select(
        k.alias("project"), F.when(k % 2 == 0, "in").otherwise("mm").alias("units"), ((k % 40) / 7.0).alias("margin"), ((k % 13) / 9.0).alias("bleed"),
        (t / 900).alias("page_width"), (t / 1100).alias("page_height"), (t / 2100).alias("image_width"),
    )
    return A.convert_units(p)

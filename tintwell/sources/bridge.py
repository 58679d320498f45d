"""Views that read the shared test tables as pixel, coverage, palette, curve and change tables.

Every bridge is one narrow projection of one parquet table, so column pruning
reaches the scan and nothing is shuffled. `SQL` holds the same definitions for
the SQL side of a comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tintwell.session import read_table, spread


def to_byte(v: Column) -> Column:
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor(v * 256 + 128))).cast("int")


def clamp_byte(v: Column) -> Column:
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor(v))).cast("int")


def gray8(spark: SparkSession, folder: str) -> DataFrame:
    """One 8x8 gray image per vector: image_id, label, p, x, y, g."""
    vectors = spread(read_table(spark, folder, "embeddings"))
    cells = vectors.select(F.col("vec_id").alias("image_id"), "label", F.posexplode("embedding").alias("p", "v"))
    return cells.select(
        "image_id",
        "label",
        "p",
        (F.col("p") % 8).alias("x"),
        F.floor(F.col("p") / 8).cast("int").alias("y"),
        to_byte(F.col("v").cast("double")).alias("g"),
    )


def _component(i: Column, step: int, k: int) -> Column:
    return to_byte(F.get(F.col("embedding"), i * step + k).cast("double"))


def rgb21(spark: SparkSession, folder: str) -> DataFrame:
    """One 7x3 RGB image per vector: image_id, x, y, r, g, b."""
    vectors = spread(read_table(spark, folder, "embeddings").select("vec_id", "embedding"))
    cells = vectors.select(F.col("vec_id").alias("image_id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("i"))
    i = F.col("i")
    return cells.select(
        "image_id",
        (i % 7).alias("x"),
        F.floor(i / 7).cast("int").alias("y"),
        _component(i, 3, 0).alias("r"),
        _component(i, 3, 1).alias("g"),
        _component(i, 3, 2).alias("b"),
    )


def cov16(spark: SparkSession, folder: str) -> DataFrame:
    """One 4x4 coverage grid of four inks per vector: image_id, x, y, k0..k3 (0..255)."""
    vectors = spread(read_table(spark, folder, "embeddings").select("vec_id", "embedding"))
    cells = vectors.select(F.col("vec_id").alias("image_id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("i"))
    i = F.col("i")
    return cells.select(
        "image_id",
        (i % 4).alias("x"),
        F.floor(i / 4).cast("int").alias("y"),
        *[_component(i, 4, k).alias(f"k{k}") for k in range(4)],
    )


def coverage(spark: SparkSession, folder: str) -> DataFrame:
    """`cov16` as fractions: image_id, x, y, c0..c3."""
    return cov16(spark, folder).select("image_id", "x", "y", *[(F.col(f"k{k}") / 255.0).alias(f"c{k}") for k in range(4)])


def flat_px(spark: SparkSession, folder: str) -> DataFrame:
    """One pixel per line item: image_id (supplier), order_key, line, r, g, b."""
    items = read_table(spark, folder, "lineitem")
    return items.select(
        F.col("l_suppkey").alias("image_id"),
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line"),
        clamp_byte(F.col("l_quantity") * 255 / 50).alias("r"),
        clamp_byte(F.col("l_discount") * 2550).alias("g"),
        clamp_byte(F.col("l_tax") * 3187).alias("b"),
    )


def images(spark: SparkSession, folder: str) -> DataFrame:
    """One image record per document."""
    docs = read_table(spark, folder, "documents").select("doc_id", "n_chars", "lang", "source")
    n = F.col("n_chars")
    return docs.select(
        F.col("doc_id").alias("image_id"),
        (64 + n % 4032).cast("int").alias("width"),
        (64 + (n * 7) % 3008).cast("int").alias("height"),
        "lang",
        "source",
        n.alias("n_chars"),
    )


def files(spark: SparkSession, folder: str) -> DataFrame:
    """One candidate upload per document: image_id, file_name, mime, bytes, width, height."""
    base = images(spark, folder)
    kind = (F.col("image_id") % 7).cast("int")
    ext = F.get(F.array(*[F.lit(e) for e in ("jpg", "PNG", "webp", "heic", "gif", "jpeg", "HEIF")]), kind)
    n = F.col("n_chars")
    return base.select(
        "image_id",
        F.concat(F.lit("scan."), F.col("image_id").cast("string"), F.lit("."), ext).alias("file_name"),
        F.when(F.col("image_id") % 3 == 0, F.when(kind == 4, F.lit("image/PNG")).otherwise(F.lit("image/webp"))).otherwise(F.lit("")).alias("mime"),
        (n * 40000).alias("bytes"),
        (F.col("width") * 3).alias("width"),
        (F.col("height") * 3).alias("height"),
    )


def palettes(spark: SparkSession, folder: str) -> DataFrame:
    """Four inks per part: palette_id, ink, hex, opacity."""
    parts = spread(read_table(spark, folder, "part").select("p_partkey", "p_size"))
    inks = parts.select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("ink"))
    seed = F.col("p_partkey") * 4 + F.col("ink")

    def channel(a: int, b: int) -> Column:
        return F.lpad(F.lower(F.hex(((seed * a + F.col("p_size") * b) % 256).cast("bigint"))), 2, "0")

    return inks.select(
        F.col("p_partkey").alias("palette_id"),
        "ink",
        F.concat(F.lit("#"), channel(73, 11), channel(151, 29), channel(199, 53)).alias("hex"),
        (((F.col("p_partkey") + F.col("ink")) % 3) / 4.0).alias("opacity"),
    )


def curve_points(spark: SparkSession, folder: str) -> DataFrame:
    """Eight control points per vector: curve_id, seq, x, y (0..1)."""
    vectors = spread(read_table(spark, folder, "embeddings").select("vec_id", "embedding"))
    cells = vectors.select(F.col("vec_id").alias("curve_id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("seq"))
    s = F.col("seq")
    return cells.select("curve_id", "seq", (_component(s, 2, 0) / 255.0).alias("x"), (_component(s, 2, 1) / 255.0).alias("y"))


def micros(ts: str = "ts") -> Column:
    """Microseconds since the epoch, independent of the session time zone."""
    # Calendar parts of a zone-less time: a difference of two times would go through the session's zone.
    t = F.col(ts).cast("timestamp_ntz")
    seconds = F.unix_date(t.cast("date")).cast("bigint") * 86_400 + F.hour(t) * 3_600 + F.minute(t) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("bigint")


def changes(spark: SparkSession, folder: str) -> DataFrame:
    """Settings changes: project, ts, us, seq, section, key, value, commit."""
    events = read_table(spark, folder, "events")
    return change_columns(events)


def change_columns(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("user_id").alias("project"),
        "ts",
        micros().alias("us"),
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("section"),
        k.alias("key"),
        "value",
        (k % 4 == 0).alias("commit"),
    )


SQL = {
    "gray8": """gray8 AS (
  SELECT vec_id AS image_id, label, p, CAST(p % 8 AS INTEGER) AS x, CAST(p // 8 AS INTEGER) AS y,
         CAST(least(255, greatest(0, floor(CAST(embedding[p + 1] AS DOUBLE) * 256 + 128))) AS INTEGER) AS g
  FROM embeddings, (SELECT CAST(range AS INTEGER) AS p FROM range(64)) q)""",
    "rgb21": """rgb21 AS (
  SELECT vec_id AS image_id, CAST(i % 7 AS INTEGER) AS x, CAST(i // 7 AS INTEGER) AS y,
         CAST(least(255, greatest(0, floor(CAST(embedding[i * 3 + 1] AS DOUBLE) * 256 + 128))) AS INTEGER) AS r,
         CAST(least(255, greatest(0, floor(CAST(embedding[i * 3 + 2] AS DOUBLE) * 256 + 128))) AS INTEGER) AS g,
         CAST(least(255, greatest(0, floor(CAST(embedding[i * 3 + 3] AS DOUBLE) * 256 + 128))) AS INTEGER) AS b
  FROM embeddings, (SELECT CAST(range AS INTEGER) AS i FROM range(21)) q)""",
    "cov16": """cov16 AS (
  SELECT vec_id AS image_id, CAST(i % 4 AS INTEGER) AS x, CAST(i // 4 AS INTEGER) AS y,
         CAST(least(255, greatest(0, floor(CAST(embedding[i * 4 + 1] AS DOUBLE) * 256 + 128))) AS INTEGER) AS k0,
         CAST(least(255, greatest(0, floor(CAST(embedding[i * 4 + 2] AS DOUBLE) * 256 + 128))) AS INTEGER) AS k1,
         CAST(least(255, greatest(0, floor(CAST(embedding[i * 4 + 3] AS DOUBLE) * 256 + 128))) AS INTEGER) AS k2,
         CAST(least(255, greatest(0, floor(CAST(embedding[i * 4 + 4] AS DOUBLE) * 256 + 128))) AS INTEGER) AS k3
  FROM embeddings, (SELECT CAST(range AS INTEGER) AS i FROM range(16)) q)""",
    "coverage": """coverage AS (
  SELECT image_id, x, y, k0 / 255.0::DOUBLE AS c0, k1 / 255.0::DOUBLE AS c1, k2 / 255.0::DOUBLE AS c2, k3 / 255.0::DOUBLE AS c3 FROM cov16)""",
    "flat_px": """flat_px AS (
  SELECT l_suppkey AS image_id, l_orderkey AS order_key, l_linenumber AS line,
         CAST(least(255, greatest(0, floor(l_quantity * 255 / 50))) AS INTEGER) AS r,
         CAST(least(255, greatest(0, floor(l_discount * 2550))) AS INTEGER) AS g,
         CAST(least(255, greatest(0, floor(l_tax * 3187))) AS INTEGER) AS b
  FROM lineitem)""",
    "images": """images AS (
  SELECT doc_id AS image_id, CAST(64 + n_chars % 4032 AS INTEGER) AS width,
         CAST(64 + (n_chars * 7) % 3008 AS INTEGER) AS height, lang, source, n_chars FROM documents)""",
    "files": """files AS (
  SELECT image_id, 'scan.' || image_id || '.' || (['jpg','PNG','webp','heic','gif','jpeg','HEIF'])[CAST(image_id % 7 AS INTEGER) + 1] AS file_name,
         CASE WHEN image_id % 3 = 0 THEN CASE WHEN image_id % 7 = 4 THEN 'image/PNG' ELSE 'image/webp' END ELSE '' END AS mime,
         n_chars * 40000 AS bytes, width * 3 AS width, height * 3 AS height FROM images)""",
    "palettes": """palettes AS (
  SELECT p_partkey AS palette_id, ink,
         '#' || lower(printf('%02x%02x%02x', (seed * 73 + p_size * 11) % 256, (seed * 151 + p_size * 29) % 256, (seed * 199 + p_size * 53) % 256)) AS hex,
         ((p_partkey + ink) % 3) / 4.0::DOUBLE AS opacity
  FROM (SELECT p_partkey, p_size, ink, p_partkey * 4 + ink AS seed FROM part, (SELECT CAST(range AS INTEGER) AS ink FROM range(4)) q) t)""",
    "curve_points": """curve_points AS (
  SELECT vec_id AS curve_id, seq,
         least(255, greatest(0, floor(CAST(embedding[seq * 2 + 1] AS DOUBLE) * 256 + 128))) / 255.0::DOUBLE AS x,
         least(255, greatest(0, floor(CAST(embedding[seq * 2 + 2] AS DOUBLE) * 256 + 128))) / 255.0::DOUBLE AS y
  FROM embeddings, (SELECT CAST(range AS INTEGER) AS seq FROM range(8)) q)""",
    "changes": """changes AS (
  SELECT user_id AS project, ts, epoch_us(ts) AS us, event_id AS seq, event_type AS section,
         CAST(props->>'$.k' AS INTEGER) AS key, value, CAST(props->>'$.k' AS INTEGER) % 4 = 0 AS commit FROM events)""",
}

_NEEDS = {"coverage": ["cov16"], "files": ["images"]}


def ctes(*names: str) -> str:
    """`WITH` list of the named bridges (and what they need) in SQL, ready for more entries after a comma."""
    wanted: list[str] = []
    for name in names:
        for part in [*_NEEDS.get(name, []), name]:
            if part not in wanted:
                wanted.append(part)
    return "WITH " + ",\n".join(SQL[name] for name in wanted)

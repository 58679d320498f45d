"""Image files to pixel tables, and coverage layers to files."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tintwell.operators.settings import layer_name, number_slots
from tintwell.operators.split import MAX_INKS


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """File records without their contents: path, file_name, mime (empty), bytes.

    Only the path and length columns are read; the contents stay on disk.
    """
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), F.lit("").alias("mime"), F.col("length").alias("bytes"))


#: Pixels handed on at a time.
SLICE = 1 << 16


def _decoded(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    files = spark.read.format("image").option("dropInvalid", "false").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(*[F.col(f"image.{c}").alias(n) for c, n in (("origin", "path"), ("width", "width"), ("height", "height"), ("nChannels", "n"), ("data", "data"))])


def unreadable_images(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files that no decoder could read, with a reason: path, reason. WebP has no decoder here and is always among them."""
    return _decoded(spark, path, pattern).where("height <= 0 OR width <= 0").select("path", F.lit("cannot be decoded").alias("reason"))


def pixels_from_images(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Every pixel of every decodable image: path, width, height, x, y, r, g, b, a.

    An image's bytes (BGR, BGRA or gray) are read once as an array and handed on in slices of whole rows, so a large
    image takes little more than itself. `unreadable_images` names the files that are left out.
    """

    def expand(batches):
        for batch in batches:
            for img in batch.itertuples(index=False):
                data = np.frombuffer(img.data, np.uint8).reshape(img.height, img.width, img.n)
                step = max(1, SLICE // img.width)
                for top in range(0, img.height, step):
                    part = data[top : top + step].astype(np.int32).reshape(-1, img.n)
                    rows = len(part) // img.width
                    gray = img.n == 1
                    yield pd.DataFrame(
                        {
                            "path": img.path,
                            "width": img.width,
                            "height": img.height,
                            "x": np.tile(np.arange(img.width), rows),
                            "y": np.repeat(np.arange(top, top + rows), img.width),
                            "r": part[:, 0 if gray else 2],
                            "g": part[:, 0 if gray else 1],
                            "b": part[:, 0],
                            "a": part[:, 3] if img.n == 4 else 255,
                        }
                    )

    good = _decoded(spark, path, pattern).where("height > 0 AND width > 0")
    return good.mapInPandas(expand, "path string, width int, height int, x int, y int, r int, g int, b int, a int")


def layer_rows(cov: DataFrame, inks: DataFrame, project: str) -> DataFrame:
    """Coverage as one row per pixel and layer: image_id, print_order, layer, x, y, v (0..255, 255 = paper).

    `inks`: palette order of the catalogue (ink, hex), at most four rows.
    """
    named = number_slots(inks.withColumn("_k", F.lit(1)), ["_k"])
    named = named.select("ink", "print_order", layer_name(F.lit(project), F.col("print_order"), F.col("hex")).alias("layer"))
    stacked = F.explode(F.array(*[F.struct(F.lit(k).alias("ink"), F.col(f"c{k}").alias("c")) for k in range(MAX_INKS)]))
    long = cov.select("image_id", "x", "y", stacked.alias("s")).select("image_id", "x", "y", "s.*")
    v = F.lit(255) - F.floor(F.col("c") * 255 + 0.5).cast("int")
    return long.join(F.broadcast(named), "ink").select("image_id", "print_order", "layer", "x", "y", v.alias("v"))


def write_layers(layers: DataFrame, path: str) -> None:
    """One folder per ink in print order, its rows sorted by image.

    Rows are dealt by ink and image and then rebalanced, so the number of writers and the size of files follow the data
    and one huge image is split; a read of some images prunes by the ranges in the files.
    """
    dealt = layers.hint("rebalance", F.col("print_order"), F.col("image_id"))
    dealt.sortWithinPartitions("print_order", "image_id", "y", "x").write.mode("overwrite").partitionBy("print_order").parquet(path)


def read_layers(spark: SparkSession, path: str, print_order: int | None = None) -> DataFrame:
    """Layers read back; a print order prunes to its folder."""
    rows = spark.read.parquet(path)
    return rows if print_order is None else rows.where(F.col("print_order") == print_order)

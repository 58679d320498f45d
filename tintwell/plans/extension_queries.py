"""The extension surface over whole tables: user statistics and a generator."""

from __future__ import annotations

from pyspark.sql import functions as F

from tintwell import extensions as X
from tintwell.plans.curve_queries import R
from tintwell.plans.registry import query
from tintwell.sources import bridge as B


@query(
    "k3_statistics",
    B.ctes("flat_px")
    + """, f AS (SELECT image_id, CAST(r AS DOUBLE) AS v, count(*) AS n FROM flat_px GROUP BY 1, 2),
c AS (SELECT *, sum(n) OVER (PARTITION BY image_id ORDER BY v) AS upto, sum(n) OVER (PARTITION BY image_id) AS total, sum(v * n) OVER (PARTITION BY image_id ORDER BY v) AS held, sum(v * n) OVER (PARTITION BY image_id) AS whole FROM f),
m AS (SELECT image_id, min(v) AS med FROM c WHERE upto >= 0.5::DOUBLE * total GROUP BY image_id),
o AS (SELECT image_id, abs(v - med) AS d, sum(n) AS n FROM f JOIN m USING (image_id) GROUP BY 1, 2),
p AS (SELECT *, sum(n) OVER (PARTITION BY image_id ORDER BY d) AS upto, sum(n) OVER (PARTITION BY image_id) AS total FROM o),
dev AS (SELECT image_id, min(d) AS deviation FROM p WHERE upto >= 0.5::DOUBLE * total GROUP BY image_id)
SELECT c.image_id, round(max(deviation), 6) AS deviation, round(CASE WHEN max(whole) > 0 THEN sum(n * (2 * held - v * n)) / (max(total) * max(whole)) END, 6) AS evenness FROM c JOIN dev USING (image_id) GROUP BY c.image_id""",
)
def k3_statistics(spark, folder):
    """Spread and evenness of the red of every image."""
    out = X.group_statistics(B.flat_px(spark, folder), ["image_id"], "r", ["deviation", "evenness"])
    return out.select("image_id", R("deviation", "deviation"), R("evenness", "evenness"))


_GOLDEN = "pi() * (3 - sqrt(5.0::DOUBLE))"


@query(
    "k3_covering_points",
    B.ctes("gray8")
    + f""", s AS (SELECT image_id, 40 + g AS width, 30 + p AS height, 4 + g % 5 AS cell, CASE WHEN image_id % 2 = 0 THEN 137.5 ELSE 100.0 END::DOUBLE AS degrees FROM gray8 WHERE p < 4),
e AS (SELECT image_id, degrees, CAST(pow(2, ceil(log2(pow(sqrt(pow(width / 2, 2) + pow(height / 2, 2)) / cell + 3, 2) * pi()))) AS BIGINT) AS need FROM s),
c AS (SELECT image_id, max(need) AS need, max(degrees) AS degrees FROM e GROUP BY image_id),
t AS (SELECT image_id, unnest(range(need)) AS n, CASE WHEN degrees = 137.5 THEN {_GOLDEN} ELSE radians(degrees) END AS turn FROM c)
SELECT image_id, n, round(sqrt(n / pi()) * cos(n * turn), 5) AS x, round(sqrt(n / pi()) * sin(n * turn), 5) AS y FROM t""",
)
def k3_covering_points(spark, folder):
    """Points for four screens of every image; each image takes those of its finest screen."""
    g = B.gray8(spark, folder).where("p < 4")
    degrees = F.when(F.col("image_id") % 2 == 0, 137.5).otherwise(100.0)
    screens = g.select("image_id", (F.col("g") + 40).alias("width"), (F.col("p") + 30).alias("height"), (F.col("g") % 5 + 4).cast("double").alias("cell"), degrees.alias("degrees"))
    return X.covering_points(screens).select("image_id", "n", R("x", "x", 5), R("y", "y", 5))

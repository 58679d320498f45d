"""User statistics and generators: an Arrow aggregate over folded groups, and a partitioned table function."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tintwell.operators.halftone import divergence

#: `fn(values, counts)` gives one number for a group, from its distinct values in rising order and how often each occurs.
STATISTICS: dict[str, Callable[[np.ndarray, np.ndarray], float | None]] = {}


def statistic(name: str):
    def register(fn):
        STATISTICS[name] = fn
        return fn

    return register


def aggregate(name: str) -> Callable[[Column, Column], Column]:
    """A registered statistic as an aggregate of two columns, value and count. Null values and counts below one are left out."""
    if name not in STATISTICS:
        raise KeyError(f"no statistic named {name}; known: {sorted(STATISTICS)}")
    fn = STATISTICS[name]

    def run(values: pa.Array, counts: pa.Array) -> float:
        v, n = values.to_numpy(zero_copy_only=False), counts.fill_null(0).to_numpy(zero_copy_only=False)
        own = ~np.isnan(v) & (n > 0)
        distinct, place = np.unique(v[own], return_inverse=True)
        return fn(distinct, np.bincount(place, n[own]).astype(np.int64)) if len(distinct) else None

    return F.arrow_udf(run, "double")


def group_statistics(df: DataFrame, keys: list[str], value: str | Column, names: list[str]) -> DataFrame:
    """keys and a column for each statistic, of every group.

    Rows fold to (value, count) first, which combines before the shuffle. So a group reaches its task as its distinct
    values, 256 of them for bytes, however many rows it has. Values should come from such a bounded domain. A group whose
    values are all null gets nulls.
    """
    v = F.col(value) if isinstance(value, str) else value
    folded = df.select(*keys, v.cast("double").alias("_v")).groupBy(*keys, "_v").agg(F.count("*").cast("long").alias("_n"))
    return folded.groupBy(*keys).agg(*[aggregate(n)("_v", "_n").alias(n) for n in names])


def _at_share(values: np.ndarray, counts: np.ndarray, share: float) -> float:
    """Smallest value that at least this share of the rows does not exceed."""
    upto = np.cumsum(counts)
    return float(values[np.searchsorted(upto, share * upto[-1])])


@statistic("deviation")
def deviation(values: np.ndarray, counts: np.ndarray) -> float:
    """Median distance from the median."""
    off = np.abs(values - _at_share(values, counts, 0.5))
    order = np.argsort(off, kind="stable")
    return _at_share(off[order], counts[order], 0.5)


@statistic("evenness")
def evenness(values: np.ndarray, counts: np.ndarray) -> float | None:
    """1 less the Gini coefficient: 1 where all rows have the same value, near 0 where one row has everything."""
    total = float((values * counts).sum())
    if total <= 0:
        return None
    n = counts.sum()
    held = np.cumsum(values * counts)
    # Twice the area under the Lorenz curve, a strip for each distinct value.
    return float((counts * (2 * held - values * counts)).sum() / (n * total))


#: Points that leave a generator at once.
POINTS = 8192


@F.arrow_udtf(returnType="image_id long, n long, x double, y double")
class SpiralPoints:
    """Sunflower points that cover every screen of an image: called over a table partitioned by image_id.

    Rows have image_id, width, height, cell (output px) and degrees. The image gets the points of its most demanding row,
    a power of two of them, in units of a cell, at the angle of that row; they stream out in blocks.
    """

    def __init__(self):
        self.image, self.count, self.degrees = None, 0, 0.0

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        width, height, cell, degrees = (np.asarray(rows.column(c), dtype=float) for c in ("width", "height", "cell", "degrees"))
        far = np.hypot(width / 2, height / 2) / np.maximum(1.0, cell) + 3
        for k, need in enumerate(np.ceil(np.log2(far * far * math.pi))):
            if (1 << int(need), degrees[k]) > (self.count, self.degrees):
                self.image, self.count, self.degrees = rows.column("image_id")[k].as_py(), 1 << int(need), float(degrees[k])
        return iter(())

    def terminate(self) -> Iterator[pa.Table]:
        turn = math.radians(divergence(self.degrees))
        for at in range(0, self.count, POINTS):
            n = np.arange(at, min(self.count, at + POINTS))
            r = np.sqrt(n / math.pi)
            image = pa.array([self.image], pa.int64()).take(pa.array(np.zeros(len(n), dtype=np.int64)))
            yield pa.table({"image_id": image, "n": n, "x": r * np.cos(n * turn), "y": r * np.sin(n * turn)})


def covering_points(screens: DataFrame) -> DataFrame:
    """image_id, n, x, y: spiral points for the screens (image_id, width, height, cell, degrees) of every image."""
    rows = screens.select("image_id", "width", "height", "cell", F.col("degrees").cast("double").alias("degrees"))
    return SpiralPoints(rows.asTable().partitionBy("image_id"))

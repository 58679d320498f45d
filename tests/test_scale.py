"""Plans and memory that must not grow with the table."""

import itertools
import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tintwell import extensions as X
from tintwell.operators import curves as D
from tintwell.operators import halftone as H
from tintwell.operators import palette as P
from tintwell.operators import spatial as SP
from tintwell.streaming import logs as ST


def broadcasts(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_tone_tables_are_not_broadcast(spark):
    pts = spark.range(3).select(F.col("id").alias("k"), F.explode(F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(float(i)).alias("x"), F.lit(float(i)).alias("y")) for i in (0, 1)])).alias("p")).select("k", "p.*")
    settings = spark.range(3).select(F.col("id").alias("k"), F.lit(0.0).alias("black"), F.lit(1.0).alias("white"), F.lit(0.0).alias("mid"), F.lit(False).alias("invert"), F.lit(1.0).alias("density"))
    lut = D.tone_lut(settings, D.sample_curves(pts, ["k"], 1024), ["k"])
    assert broadcasts(lut) == 0
    assert lut.where("i <> v").isEmpty() and lut.count() == 3 * 256


def test_noise_fields_are_not_broadcast(spark):
    seeds = spark.range(3).withColumnRenamed("id", "sid")
    assert broadcasts(H.noise_field(seeds, "sid", "green", 8)) == 0
    assert broadcasts(H.blue_field(seeds, "sid", 8)) == broadcasts(H.pink_field(seeds, "sid", 8)) == 0
    assert H.noise_field(seeds, "sid", "green", 8).count() == 3 * 64


def test_sets_of_inks_are_not_broadcast(spark):
    i = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("id")
    inks = spark.range(3).select(F.col("id").cast("int").alias("k"), i).selectExpr("k", "id", "0.1D * (id + 1) AS share", "20D * id AS l", "9D * k AS a", "5D * id AS b")
    sets = P.combinations(inks, ["k"], 3)
    assert broadcasts(sets) == 0 and sets.count() == 3 * 10
    lead = inks.where("id < 3").groupBy("k").agg(F.reverse(F.array_sort(F.collect_list(F.struct("l", "a", "b")))).alias("inks"))
    chosen = P.choose_palette(inks, ["k"], 3, "balanced", 0, lead)
    assert broadcasts(chosen) == 0
    assert {r["k"]: [x["l"] for x in r["inks"]] for r in chosen.collect()} == dict.fromkeys(range(3), [40.0, 20.0, 0.0])


def test_disc_reach_groups_by_cell(spark):
    """A group is a cell, not each of its 16 points; cells may be missing, doubled or without a threshold."""
    cells = [(1, x, y, (x * 5 + y * 3) % 7 / 7.0) for x in range(4) for y in range(4) if (x, y) != (2, 2)] + [(1, 0, 0, 0.9), (2, 1, 1, None)]
    out = SP.disc_reach(spark.createDataFrame(cells, "k int, tx int, ty int, threshold double"), ["k"], 4)
    assert "keys=[k#" in (plan := out._jdf.queryExecution().executedPlan().toString()) and not re.search(r"keys=\[[^]]*\bsx#", plan)
    want = {}
    for k, x, y, t in cells:
        for dx, dy, sx, sy in itertools.product((-1, 0, 1), (-1, 0, 1), range(4), range(4)):
            if (dx + (sx + 0.5) / 4 - 0.5) ** 2 + (dy + (sy + 0.5) / 4 - 0.5) ** 2 <= 0.5:
                at = (k, (x + dx) % 4, (y + dy) % 4, sx, sy)
                want[at] = min((v for v in (want.get(at), t) if v is not None), default=None)
    got = {tuple(r)[:5]: r["reach"] for r in out.collect()}
    assert got == want and out.count() == len(want)


def test_dot_coverage_reads_reach_once(spark):
    reach = spark.createDataFrame([(1, 0.1), (1, 0.5), (1, 0.9), (2, 2.0)], "k int, reach double").repartition(3)
    out = H.dot_coverage(reach, ["k"], 4)
    assert broadcasts(out) == 0
    assert {(r["k"], r["i"]): round(r["v"], 6) for r in out.collect()} == {(1, 0): 0, (1, 1): 0.333333, (1, 2): 0.333333, (1, 3): 0.666667, (1, 4): 1, **{(2, i): 0 for i in range(5)}}


def test_spiral_points_leave_in_blocks():
    gen = object.__new__(X.SpiralPoints.func)
    gen.__init__()
    rows = pa.record_batch({"image_id": [7, 7], "width": [4000, 40], "height": [3000, 30], "cell": [8.0, 0.5], "degrees": [100.0, 100.0]})
    assert list(gen.eval(rows)) == []
    out = list(gen.terminate())
    n = np.concatenate([t["n"].to_numpy() for t in out])
    assert len(out) > 1 and max(t.num_rows for t in out) <= X.POINTS and (n == np.arange(gen.count)).all() and gen.count == 1 << 19
    last = out[-1].slice(out[-1].num_rows - 1).to_pylist()[0]
    r, a = math.sqrt(n[-1] / math.pi), n[-1] * math.radians(100.0)
    assert last == {"image_id": 7, "n": n[-1], "x": pytest.approx(r * math.cos(a)), "y": pytest.approx(r * math.sin(a))}


def test_stream_folds_keep_and_give_few_columns():
    """A group's key and times are not held, and its results leave in blocks in log order."""

    class One:
        def __init__(self):
            self.v = None

        exists = lambda self: self.v is not None
        get = lambda self: self.v

        def update(self, v):
            self.v = v

    n = 2 * ST.BLOCK + 5
    seq = np.random.default_rng(1).permutation(n)
    rows = pd.DataFrame({"section": "click", "seq": seq, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(seq, "s"), "value": seq * 7 % 11 / 1.0})
    data, newest = ST._ordered(iter([rows[:100], rows[100:]]), ST.Costs.columns)
    assert list(data.columns) == ["seq", "value"] and (data.seq == np.arange(n)).all() and newest == rows.ts.max()
    fold = ST.Costs("1 hour", "section")
    fold.cost = One()
    out = list(fold.fold(("click",), data))
    assert [len(b) for b in out] == [ST.BLOCK, ST.BLOCK, 5]
    cost, want = None, []
    for v in data.value:
        cost = v if cost is None or v > cost else cost * 0.8 + v * 0.2
        want.append(cost)
    assert pd.concat(out).cost.tolist() == want and fold.cost.v == (cost,)


def test_settled_images_leave_the_rounds(spark, monkeypatch):
    """An image whose centres stand still is in no further round; a cluster named twice moves as one, and blocks do not show."""
    cut, seen = P.cut_lineage, []
    monkeypatch.setattr(P, "cut_lineage", lambda df: seen.append(cut(df)) or seen[-1])
    line = np.arange(600.0)
    rows = [(1, n, v) for n, v in enumerate([0.0, 5.0])] + [(2, n, float(v)) for n, v in enumerate(line)]
    points = spark.createDataFrame(rows, "k int, pid int, l double").selectExpr("k", "pid", "l", "0D AS a", "0D AS b")
    starts = [(1, 0, 0.0), (1, 1, 5.0), (2, 0, 0.0), (2, 1, 1.0), (2, 1, 1.0)]
    centers = spark.createDataFrame(starts, "k int, cluster int, l double").selectExpr("k", "0 AS restart", "cluster", "false AS fixed", "l", "0D AS a", "0D AS b")
    out = P.kmeans_runs(points, centers, ["k"], 1)
    moved = [df for df in seen if {"_move", "move2"} & set(df.columns)]
    assert len(moved) > 3 and moved[-1].select("k").distinct().count() == 1
    want = np.array([0.0, 1.0])
    for _ in moved:
        near = np.abs(line[:, None] - want).argmin(axis=1)
        want = np.array([line[near == i].mean() for i in (0, 1)])
    got = sorted((r["k"], r["cluster"], r["l"]) for r in out.collect())
    assert got == [(1, 0, 0.0), (1, 1, 5.0), (2, 0, pytest.approx(want[0])), (2, 1, pytest.approx(want[1])), (2, 1, pytest.approx(want[1]))]

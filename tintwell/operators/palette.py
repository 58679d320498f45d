"""Palettes from pixels: histograms, clustering, candidate colours and their combinations.

All steps work on every image at once. Groups of pixels are only ever summed,
counted or ranked with bounded buckets; the per-image lists that remain (cluster
centres, candidate colours, ranked palettes) hold a few dozen rows.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tintwell.functions import color as C
from tintwell.functions import hashing
from tintwell.functions.color import Triple, clamp01, half_up, num
from tintwell.operators.ranks import PER_GROUP, value_ranks
from tintwell.operators.spatial import resample
from tintwell.session import cut_lineage

LAB = ["l", "a", "b"]
SAMPLE_EDGE = 160
ITERATIONS = 30
#: Squared move below which a centre counts as still.
STILL = 1e-4
#: Points of a block, and blocks that are looked at together.
BLOCK = 256
CENTERS = "array<struct<restart: int, cluster: int, fixed: boolean, l: double, a: double, b: double>>"
STRONG_SHARE = 0.3
SAME_COLOR = 12.0
MAX_PALETTES = 24
# Colours offered, in order, for a new ink.
NEW_INKS = ["#0078bf", "#ff48b0", "#ffe800", "#000000", "#00a95c", "#ff6c2f", "#765ba7"]


def lab_of(prefix: str = "") -> Triple:
    return F.col(f"{prefix}l"), F.col(f"{prefix}a"), F.col(f"{prefix}b")


# ---- histogram ----


def histogram(pixels: DataFrame, keys: list[str], source: str = "luma") -> DataFrame:
    """Pixels per lightness step: keys, bin, n (transparent pixels left out where there is an `a`)."""
    rgb = (F.col("r"), F.col("g"), F.col("b"))
    if "a" in pixels.columns:
        pixels = pixels.where(F.col("a") > 0)
    l = clamp01(C.lightness(C.rgb_to_linear(rgb), source, tuple(c / 255.0 for c in rgb)))
    return pixels.groupBy(*keys, half_up(l * 255).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def sample_lab(pixels: DataFrame, images: DataFrame, edge: int = SAMPLE_EDGE) -> DataFrame:
    """Lab pixels of a copy whose long side is at most `edge`: image_id, x, y, l, a, b.

    `pixels`: image_id, x, y, r, g, b, alpha (bytes). Averages in linear light,
    and leaves out what ends up less than half opaque.
    """
    k = F.least(num(1), num(edge) / F.greatest("width", "height"))
    side = lambda c: F.greatest(F.lit(1), half_up(F.col(c) * k).cast("int"))
    sized = images.select("image_id", "width", "height", side("width").alias("out_w"), side("height").alias("out_h"))
    lin = C.rgb_to_linear((F.col("r"), F.col("g"), F.col("b")))
    source = pixels.select("image_id", "x", "y", *[c.alias(f"_{n}") for n, c in zip("rgb", lin)], F.col("alpha").cast("double").alias("_alpha"))
    shrunk = resample(source, sized, ["_r", "_g", "_b", "_alpha"]).where(F.col("_alpha") >= 128)
    # Bytes again, as a copy of the image would hold.
    lab = C.rgb_to_lab(C.linear_to_rgb((F.col("_r"), F.col("_g"), F.col("_b"))))
    return shrunk.select("image_id", "x", "y", *[c.alias(n) for c, n in zip(lab, LAB)])


# ---- clustering ----


def weighted_pick(rows: DataFrame, keys: list[str], order: str, weight: str, draw: Column, block: int = 4096) -> DataFrame:
    """First row whose running weight reaches `draw` of the total: keys, order.

    Rows fall into blocks of `block` order values; block totals are summed
    first, so only the block that holds the answer is walked.
    """
    cut = F.floor(F.col(order) / block)
    sums = rows.groupBy(*keys, cut.alias("_block")).agg(F.sum(weight).alias("_w"))
    w = Window.partitionBy(*keys).orderBy("_block")
    whole = Window.partitionBy(*keys)
    spans = sums.select(
        *keys, "_block", "_w", F.sum("_w").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_upto"), F.sum("_w").over(whole).alias("_total")
    )
    spans = spans.withColumn("_target", draw * F.col("_total"))
    hit = spans.where(F.col("_upto") >= F.col("_target")).groupBy(*keys).agg(F.min_by(F.struct("_block", (F.col("_upto") - F.col("_w")).alias("_before"), "_target"), "_block").alias("h"))
    inside = rows.withColumn("_block", cut).join(hit.select(*keys, "h._block", "h._before", "h._target"), [*keys, "_block"])
    running = F.col("_before") + F.sum(weight).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return inside.withColumn("_run", running).where(F.col("_run") >= F.col("_target")).groupBy(*keys).agg(F.min(order).alias(order))


def nearest_center(points: DataFrame, centers: DataFrame, keys: list[str]) -> DataFrame:
    """Adds cluster and d2 of each point's nearest centre.

    Centres become one short array per key (a few dozen structs), so a point
    meets its centres in one join and picks the smallest distance in place.
    """
    packed = centers.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cluster", *LAB))).alias("_centers"))
    p = lab_of()
    options = F.transform("_centers", lambda c: F.struct(C.distance2(p, (c["l"], c["a"], c["b"])).alias("d2"), c["cluster"].alias("cluster")))
    return points.join(packed, keys).withColumn("_best", F.array_min(options)).select(*points.columns, "_best.cluster", "_best.d2")


def move_centers(assigned: DataFrame, centers: DataFrame, keys: list[str]) -> DataFrame:
    """One update: means of the members; fixed and empty clusters stay. Adds move2."""
    means = assigned.groupBy(*keys, "cluster").agg(*[F.avg(c).alias(f"_{c}") for c in LAB])
    joined = centers.join(means, [*keys, "cluster"], "left")
    still = F.col("fixed") | F.col("_l").isNull()
    new = [F.when(still, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in LAB]
    move = F.when(still, num(0)).otherwise(C.distance2(lab_of("_"), lab_of()))
    return joined.select(*keys, "cluster", "fixed", *new, move.alias("move2"))


def kmeans(points: DataFrame, centers: DataFrame, keys: list[str], iterations: int = ITERATIONS) -> DataFrame:
    """Lloyd iterations for every key at once: keys, cluster, fixed, l, a, b.

    `points`: keys, l, a, b. Each round is one map-side-combined aggregation of
    the points and a reliable checkpoint of the few centres; it stops when no
    centre of any key moves by more than 0.01.
    """
    for _ in range(iterations):
        updated = cut_lineage(move_centers(nearest_center(points, centers, keys), centers, keys))
        centers = updated.drop("move2")
        if updated.where(F.col("move2") > STILL).isEmpty():
            return centers
    warnings.warn(f"centres still move after {iterations} rounds", stacklevel=2)
    return centers


# Restarts run side by side. Centres have a column `restart`; a point meets the centres of all restarts in one row, so points
# are neither copied nor moved once more for a restart. Points travel in blocks, and all centres of a key in one row.


def nearest_runs(points: DataFrame, centers: DataFrame, keys: list[str], restarts: int) -> DataFrame:
    """Adds _c0, _d0, _c1, ...: cluster and squared distance of each point's nearest centre in every restart."""
    own = lambda r: F.when(F.col("restart") == r, F.struct("cluster", *LAB))
    # A few dozen centres for each key.
    packed = centers.groupBy(*keys).agg(*[F.array_sort(F.collect_list(own(r))).alias(f"_r{r}") for r in range(restarts)])
    p = lab_of()
    best = lambda r: F.array_min(F.transform(f"_r{r}", lambda c: F.struct(C.distance2(p, (c["l"], c["a"], c["b"])).alias("d2"), c["cluster"].alias("cluster"))))
    met = points.join(packed, keys).select(*points.columns, *[best(r).alias(f"_b{r}") for r in range(restarts)])
    return met.select(*points.columns, *[F.col(f"_b{r}.{c}").alias(f"_{n}{r}") for r in range(restarts) for c, n in (("cluster", "c"), ("d2", "d"))])


def point_blocks(points: DataFrame, keys: list[str], restarts: int = 0) -> DataFrame:
    """A key's points in blocks of about BLOCK as arrays, written once: keys, _l, _a, _b, and with `restarts` _pid and a hash for each.

    With a `pid` a block is a range of it, else a range of rows; results do not depend on how points are cut.
    """
    own = F.floor(F.col("pid") / BLOCK) if "pid" in points.columns else F.floor(F.monotonically_increasing_id() / BLOCK)
    hashed = [F.xxhash64(*keys, "pid", F.lit(r)).bitwiseAND(F.lit(0x7FFFFFFF).cast("bigint")).alias(f"h{r}") for r in range(restarts)]
    named = [*LAB, *(["pid"] if restarts else [])]
    rows = points.select(*keys, own.alias("_block"), F.struct(*named, *hashed).alias("_p"))
    blocks = rows.groupBy(*keys, "_block").agg(F.collect_list("_p").alias("_p"))
    return cut_lineage(blocks.select(*keys, *[F.col(f"_p.{c}").alias(f"_{c}") for c in [*named, *(f"h{r}" for r in range(restarts))]]))


def _pack(centers: DataFrame, keys: list[str]) -> DataFrame:
    """keys, _id, _centers: all centres of a key, a few dozen, by restart and cluster."""
    packed = centers.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("restart", "cluster", "fixed", *LAB))).alias("_centers"))
    return cut_lineage(packed.withColumn("_id", F.monotonically_increasing_id()))


def _unpack(packed: DataFrame, keys: list[str]) -> DataFrame:
    return packed.select(*keys, F.explode("_centers").alias("c")).select(*keys, *[f"c.{c}" for c in ("restart", "cluster", "fixed", *LAB)])


def _met(blocks: DataFrame, packed: DataFrame, keys: list[str], extra: list[str]) -> DataFrame:
    """Blocks beside the centres of their key: _id, _l, _a, _b, the extra columns, _restart, _cluster and _c_l, _c_a, _c_b. A key's blocks follow one another."""
    beside = blocks.join(packed.hint("merge"), keys)
    return beside.select("_id", *[f"_{c}" for c in LAB], *extra, *[F.col(f"_centers.{c}").alias(f"_{c}") for c in ("restart", "cluster")], *[F.col(f"_centers.{c}").alias(f"_c_{c}") for c in LAB])


def _flat(column: pa.Array) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False)


def _places(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each centre of a batch: its row, restart and place in the row's list, that of the first where a cluster is named twice."""
    at, of, cluster = pc.list_parent_indices(batch.column("_restart")).to_numpy(), _flat(batch.column("_restart")), _flat(batch.column("_cluster"))
    size = np.bincount(at, minlength=batch.num_rows)
    start = np.cumsum(size) - size
    again = np.append(False, (at[1:] == at[:-1]) & (of[1:] == of[:-1]) & (cluster[1:] == cluster[:-1]))[: len(at)]
    return at, of, np.maximum.accumulate(np.where(again, 0, np.arange(len(at)))) - start[at]


def _nearest(batch: pa.RecordBatch, restarts: int) -> tuple[np.ndarray, list[np.ndarray], list[tuple[np.ndarray, np.ndarray]]]:
    """Of each point of a batch: its row, l, a, b, and in every restart the place of its nearest centre in the row's list (-1: none) and the squared distance."""
    row, p = pc.list_parent_indices(batch.column("_l")).to_numpy(), [_flat(batch.column(f"_{c}")) for c in LAB]
    at, of, first = _places(batch)
    centers = [_flat(batch.column(f"_c_{c}")) for c in LAB]
    found = []
    for r in range(restarts):
        own = np.flatnonzero(of == r)
        rows = at[own]
        count = np.bincount(rows, minlength=batch.num_rows)
        slot = np.arange(len(own)) - (np.cumsum(count) - count)[rows]
        width = max(1, int(count.max(initial=0)))
        place = np.full((batch.num_rows, width), -1)
        place[rows, slot] = first[own]
        d2 = np.zeros((len(row), width))
        for x, c in zip(p, centers):
            table = np.full((batch.num_rows, width), np.inf)
            table[rows, slot] = c[own]
            d2 += (x[:, None] - table[row]) ** 2
        # Points without a colour go, as in a minimum of nulls, to the first centre.
        best = np.where(np.isnan(d2), np.inf, d2).argmin(axis=1)
        found.append((place[row, best], d2[np.arange(len(row)), best]))
    return row, p, found


def _lists(start: np.ndarray, total: int, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(start, total).astype(np.int32)), pa.array(values))


def _sums(met: DataFrame, restarts: int) -> DataFrame:
    """_id, _n, _l, _a, _b: count and sums of the points nearest to each centre of the list, a row for each slice that a key is in."""
    names = [f"_{c}" for c in LAB]

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                ids = batch.column("_id").to_numpy()
                own, _, same = _places(batch)
                row, p, found = _nearest(batch, restarts)
                new = np.append(True, ids[1:] != ids[:-1])
                first, group = np.flatnonzero(new), np.cumsum(new) - 1
                size = pc.list_value_length(batch.column("_restart")).to_numpy()[first]
                start, total = np.cumsum(size) - size, int(size.sum())
                n, sums = np.zeros(total, np.int64), [np.zeros(total) for _ in LAB]
                for place, _ in found:
                    use = place >= 0
                    to = start[group[row[use]]] + place[use]
                    n += np.bincount(to[~np.isnan(p[0][use])], minlength=total)
                    for s, x in zip(sums, p):
                        s += np.bincount(to, weights=np.nan_to_num(x[use]), minlength=total)
                # A cluster named twice moves as one.
                told = np.repeat(start, size) + same[new[own]]
                yield pa.record_batch([pa.array(ids[first]), *[_lists(start, total, s[told]) for s in (n, *sums)]], names=["_id", "_n", *names])

    return met.mapInArrow(run, "_id long, _n array<long>, _l array<double>, _a array<double>, _b array<double>")


def _settle(blocks: DataFrame, packed: DataFrame, keys: list[str], restarts: int, iterations: int) -> DataFrame:
    """Lloyd iterations over blocks: packed centres.

    It stops when no centre of any key moves by more than 0.01. A key whose centres all stood where they were would
    repeat that round, so it is set aside, and its blocks are left behind now and then.
    """
    names = ["_n", *[f"_{c}" for c in LAB]]
    # A row for each slice: one for almost every key, a few hundred for an image of many million points.
    add = lambda c: F.aggregate(F.slice(f"_s.{c}", 2, F.greatest(F.lit(1), F.size("_s"))), F.get(f"_s.{c}", F.lit(0)), lambda x, y: F.zip_with(x, y, lambda u, v: u + v))
    done: list[DataFrame] = []
    for n in range(1, iterations + 1):
        met = _met(blocks, packed, keys, [])
        sums = _sums(met, restarts).groupBy("_id").agg(F.collect_list(F.struct(*names)).alias("_s")).select("_id", *[add(c).alias(c) for c in names])

        def moved(c: Column, i: Column) -> Column:
            count = F.coalesce(F.get("_n", i), F.lit(0))
            return F.struct(c["restart"].alias("restart"), c["cluster"].alias("cluster"), c["fixed"].alias("fixed"), *[F.when(c["fixed"] | (count == 0), c[x]).otherwise(F.get(f"_{x}", i) / count).alias(x) for x in LAB])

        stepped = packed.join(sums.hint("merge"), "_id", "left").select(*keys, "_id", F.col("_centers").alias("_old"), F.transform("_centers", moved).alias("_centers"))
        lab = lambda c: (c["l"], c["a"], c["b"])
        move = F.array_max(F.zip_with("_old", "_centers", lambda x, y: C.distance2(lab(x), lab(y))))
        packed = cut_lineage(stepped.select(*keys, "_id", "_centers", F.coalesce(move, num(0)).alias("_move")))
        if packed.where(F.col("_move") > STILL).isEmpty():
            break
        done.append(packed.where(F.col("_move") == 0).select(*keys, "_centers"))
        packed = packed.where(F.col("_move") != 0).drop("_move")
        if n in (3, 6, 12):
            blocks = cut_lineage(blocks.join(packed.select(*keys).hint("merge"), keys, "left_semi"))
    else:
        warnings.warn(f"centres still move after {iterations} rounds", stacklevel=3)
    out = packed.select(*keys, "_centers")
    for part in done:
        out = out.unionByName(part)
    return out


def kmeans_runs(points: DataFrame, centers: DataFrame, keys: list[str], restarts: int, iterations: int = ITERATIONS) -> DataFrame:
    """`kmeans` of several restarts at once: keys, restart, cluster, fixed, l, a, b."""
    return cut_lineage(_unpack(_settle(point_blocks(points, keys), _pack(centers, keys), keys, restarts, iterations), keys))


def seed_runs(points: DataFrame, keys: list[str], k: int, fixed: DataFrame | None, seed: int, restarts: int) -> DataFrame:
    """k-means++ starts: each next centre of a restart is drawn by squared distance to the chosen ones.

    `points`: keys, pid (its number within the key), l, a, b. A point's draw ln(u) / weight is the largest of all with a
    probability in proportion to its weight, so a pick is one aggregation that combines before the shuffle. u is keyed by
    the point and the restart and does not depend on partitioning; where all weights are 0 the first point is taken.
    """
    return _unpack(_seeds(point_blocks(points, keys, restarts), keys, k, fixed, seed, restarts), keys)


def _seeds(blocks: DataFrame, keys: list[str], k: int, fixed: DataFrame | None, seed: int, restarts: int) -> DataFrame:
    """Packed starts of `seed_runs`."""
    each = range(restarts)
    center = lambda r, cluster, pinned, lab: F.struct(F.lit(r).alias("restart"), F.lit(cluster).alias("cluster"), F.lit(pinned).alias("fixed"), *[lab(c).alias(c) for c in LAB])
    base, count = None, 0
    if fixed is not None:
        base, count = fixed.select(*keys, F.array(*[center(r, 0, True, F.col) for r in each]).alias("_centers")), 1
        base = cut_lineage(base.withColumn("_id", F.monotonically_increasing_id()))
    extra = ["_pid", *[f"_h{r}" for r in each]]
    found = ", ".join(f"_f{r} struct<race: double, pid: long, l: double, a: double, b: double>" for r in each)
    arrow = pa.struct([("race", pa.float64()), ("pid", pa.int64()), *[(c, pa.float64()) for c in LAB]])

    def draws(step: int):
        def run(batches):
            for whole in batches:
                for at in range(0, whole.num_rows, BLOCK):
                    batch = whole.slice(at, BLOCK)
                    pid = _flat(batch.column("_pid")).astype(np.int64)
                    if step:
                        row, p, near = _nearest(batch, restarts)
                    else:
                        row, p, near = pc.list_parent_indices(batch.column("_l")).to_numpy(), [_flat(batch.column(f"_{c}")) for c in LAB], [(None, np.ones(len(pid)))] * restarts
                    picks = []
                    for r, (_, weight) in enumerate(near):
                        u = hashing.uniform_array(hashing.pcg_array(_flat(batch.column(f"_h{r}")) + seed), step)
                        with np.errstate(divide="ignore", invalid="ignore"):
                            race = np.where(weight > 0, np.log(np.maximum(u, 1e-12)) / weight, -np.inf)
                        order = np.lexsort((-pid, race, row))
                        last = order[np.append(row[order][1:] != row[order][:-1], True)]
                        picks.append(pa.StructArray.from_arrays([pa.array(v[last]) for v in (race, pid, *p)], fields=list(arrow)))
                    yield pa.record_batch([batch.column("_id"), *picks], names=["_id", *[f"_f{r}" for r in each]])

        return run

    while count < k:
        if base is None:
            # Keys get their numbers with the first pick.
            base = cut_lineage(blocks.select(*keys).distinct().select(*keys, F.array().cast(CENTERS).alias("_centers"), F.monotonically_increasing_id().alias("_id")))
        races = _met(blocks, base, keys, extra).mapInArrow(draws(count), f"_id long, {found}")
        best = races.groupBy("_id").agg(*[F.max_by(f"_f{r}", F.struct(F.col(f"_f{r}.race"), -F.col(f"_f{r}.pid"))).alias(f"_p{r}") for r in each])
        added = F.array(*[center(r, count, False, lambda c, r=r: F.col(f"_p{r}.{c}")) for r in each])
        joined = base.join(best.hint("merge"), "_id", "left")
        grown = F.when(F.col("_p0").isNull(), F.col("_centers")).otherwise(F.array_sort(F.concat("_centers", added)))
        base = cut_lineage(joined.select(*keys, "_id", grown.alias("_centers")))
        count += 1
    return base


def best_clustering(points: DataFrame, keys: list[str], k: int, fixed: DataFrame | None, seed: int, restarts: int = 4) -> DataFrame:
    """Centres of the restart with the least total error per key."""
    blocks = point_blocks(points, keys, restarts)
    packed = _settle(blocks.select(*keys, *[f"_{c}" for c in LAB]), _seeds(blocks, keys, k, fixed, seed, restarts), keys, restarts, ITERATIONS)
    packed = cut_lineage(packed.withColumn("_id", F.monotonically_increasing_id()))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                row, _, found = _nearest(batch, restarts)
                sums = [np.bincount(row, weights=np.nan_to_num(d2), minlength=batch.num_rows) for _, d2 in found]
                yield pa.record_batch([batch.column("_id"), *map(pa.array, sums)], names=["_id", *[f"_e{r}" for r in range(restarts)]])

    errors = _met(blocks, packed, keys, []).mapInArrow(run, "_id long, " + ", ".join(f"_e{r} double" for r in range(restarts)))
    errors = errors.groupBy("_id").agg(*[F.sum(f"_e{r}").alias(f"_e{r}") for r in range(restarts)])
    least = F.array_min(F.array(*[F.struct(F.col(f"_e{r}").alias("e"), F.lit(r).alias("restart")) for r in range(restarts)]))
    best = packed.join(errors.select("_id", least["restart"].alias("_best")).hint("merge"), "_id")
    return cut_lineage(_unpack(best.select(*keys, F.filter("_centers", lambda c: c["restart"] == F.col("_best")).alias("_centers")), keys).drop("restart"))


# ---- cluster colours ----


def top_share_avg(members: DataFrame, keys: list[str], key: Column, share: float = STRONG_SHARE, prefix: str = "", per_group: int = PER_GROUP) -> DataFrame:
    """Mean Lab of the top `share` of each group's members by `key`: keys, l, a, b.

    Exact top-k by rank without sorting a whole group: members with equal keys
    share a rank, and where the cut falls inside such a tie the earlier `pid`s count.
    """
    scored = members.withColumn("_key", -key)
    take = F.greatest(F.lit(1), half_up(F.col("total") * share).cast("bigint"))
    ranks = value_ranks(scored, keys, "_key", per_group).where(F.col("below") < take).select(*keys, "_key", "n", "below", take.alias("_take"))
    chosen = scored.join(cut_lineage(ranks), [*keys, "_key"])
    whole = chosen.where(F.col("below") + F.col("n") <= F.col("_take")).select(*keys, *LAB)
    torn = cut_lineage(chosen.where(F.col("below") + F.col("n") > F.col("_take")))
    # One tie group per key at most is cut; its members are ranked by pid the same way.
    order = value_ranks(torn, keys, "pid", per_group).select(*keys, "pid", F.col("below").alias("_at"))
    part = torn.join(order, [*keys, "pid"]).where(F.col("below") + F.col("_at") < F.col("_take")).select(*keys, *LAB)
    return whole.unionByName(part).groupBy(*keys).agg(*[F.avg(c).alias(f"{prefix}{c}") for c in LAB])


def cluster_share(assigned: DataFrame, centers: DataFrame, keys: list[str], fixed_paper: bool) -> DataFrame:
    """Share of each cluster among the pixels that are not paper: keys, cluster, n, share, is_paper.

    The paper is the fixed cluster, or else the lightest one.
    """
    counts = assigned.groupBy(*keys, "cluster").agg(F.count("*").alias("n"))
    papers = centers.groupBy(*keys).agg(F.max_by("cluster", F.struct("l", -F.col("cluster"))).alias("_paper"))
    joined = counts.join(papers, keys)
    paper = (F.col("cluster") == 0) if fixed_paper else (F.col("cluster") == F.col("_paper"))
    joined = joined.withColumn("is_paper", paper)
    inked = joined.groupBy(*keys).agg(F.sum(F.when(~F.col("is_paper"), F.col("n")).otherwise(0)).alias("_inked"))
    share = F.when(~F.col("is_paper"), F.col("n") / F.greatest(F.col("_inked"), F.lit(1)))
    return joined.join(inked, keys).select(*keys, "cluster", "n", share.alias("share"), "is_paper")


def colorful(points: DataFrame, keys: list[str], per_group: int = PER_GROUP) -> DataFrame:
    """Pixels at least as colourful as the 60th percentile element (and chroma 12), lightness halved, where 20 or more."""
    scored = points.withColumn("_chroma", C.chroma(lab_of()))
    ranks = value_ranks(scored, keys, "_chroma", per_group)
    nth = F.floor(F.col("total") * 0.6)
    cuts = ranks.where((F.col("below") <= nth) & (nth < F.col("below") + F.col("n"))).select(*keys, F.greatest(num(12), F.col("_chroma")).alias("_cut"))
    kept = scored.join(cuts, keys).where(F.col("_chroma") >= F.col("_cut"))
    enough = kept.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= 20).select(*keys)
    return kept.join(enough, keys, "left_semi").select(*points.columns).withColumn("l", F.col("l") * 0.5)


def dedupe_near(first: DataFrame, second: DataFrame, keys: list[str], limit: float = 8.0) -> DataFrame:
    """Adds rows of `second` that are not close to any row kept before them: keys, id, l, a, b.

    Candidates per key are few. Against the first set it is an anti-join on the
    distance; within the second set each row is checked, in order, against the
    ones already kept, as an ordered fold of one short list.
    """
    near = C.distance2((F.col("f.l"), F.col("f.a"), F.col("f.b")), (F.col("s.l"), F.col("s.a"), F.col("s.b"))) < limit * limit
    same = [F.col(f"f.{k}") == F.col(f"s.{k}") for k in keys]
    fresh = second.alias("s").join(first.alias("f"), [*same, near], "left_anti")
    rows = fresh.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("id", *LAB))).alias("_rows"))

    def keep(kept: Column, row: Column) -> Column:
        close = F.exists(kept, lambda k: C.distance2((k["l"], k["a"], k["b"]), (row["l"], row["a"], row["b"])) < limit * limit)
        return F.when(close, kept).otherwise(F.concat(kept, F.array(row)))

    folded = F.aggregate("_rows", F.filter("_rows", lambda _: F.lit(False)), keep)
    added = rows.select(*keys, F.explode(folded).alias("r")).select(*keys, "r.*")
    return first.select(*keys, "id", *LAB).unionByName(added)


# ---- combinations ----


def combinations(candidates: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Every set of n candidates of a key: keys, ids (ascending), set (structs in that order).

    A self-join in increasing order per image; twenty candidates at most make
    4,845 sets of four.
    """
    item = candidates.select(*keys, "id", F.struct(*[F.col(c) for c in candidates.columns if c not in keys]).alias("item"))
    sets = item.select(*keys, F.array("id").alias("ids"), F.array("item").alias("set"), F.col("id").alias("_last"))
    for _ in range(n - 1):
        more = item.withColumnsRenamed({"id": "_id", "item": "_item"})
        # Estimates of the parts that candidates are made of are far too small; neither side may be broadcast.
        sets = sets.join(more.hint("merge"), keys).where(F.col("_id") > F.col("_last"))
        sets = sets.select(*keys, F.concat("ids", F.array("_id")).alias("ids"), F.concat("set", F.array("_item")).alias("set"), F.col("_id").alias("_last"))
    return sets.drop("_last")


def _pairs(n: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(n) for j in range(i + 1, n)]


def score_sets(sets: DataFrame, keys: list[str], style: str, n: int) -> DataFrame:
    """Adds `score`: how well each set of inks suits a style (balanced, vibrant or contrast).

    The set items hold share and the ink colour l, a, b. Sets have at most four
    members, so pairs are written out in the expression.
    """
    wide = sets.select("*", *[F.get("set", F.lit(i)).alias(f"_s{i}") for i in range(n)])
    lab = [tuple(F.col(f"_s{i}.{c}") for c in LAB) for i in range(n)]
    share = [F.col(f"_s{i}.share") for i in range(n)]
    total = lambda cols: sum(cols[1:], cols[0])
    dists = {(i, j): C.delta_e(lab[i], lab[j]) for i, j in _pairs(n)}
    wide = wide.withColumns({f"_d{i}{j}": d for (i, j), d in dists.items()}) if dists else wide
    wide = wide.withColumns({f"_c{i}": C.chroma(lab[i]) for i in range(n)})
    d = {p: F.col(f"_d{p[0]}{p[1]}") for p in _pairs(n)}
    chroma = [F.col(f"_c{i}") for i in range(n)]
    if style == "balanced":
        score = total(share)
    elif style == "vibrant":
        score = total([F.pow(chroma[i], num(1.5)) * F.pow(share[i], num(0.25)) * F.least(num(1), share[i] / 0.01) for i in range(n)])
    else:
        ds = list(d.values())
        score = (F.least(*ds) if len(ds) > 1 else ds[0]) + total(ds) / float(len(ds)) * 0.25 if ds else chroma[0]
        for i in range(n):
            score = score * F.least(num(1), share[i] / 0.02)
    for i, j in _pairs(n):
        penalty = F.when(d[(i, j)] < SAME_COLOR, num(0.3))
        if style == "vibrant":
            alike = (chroma[i] > 15) & (chroma[j] > 15) & (C.hue_difference(lab[i], lab[j]) < 30)
            penalty = penalty.when(alike, num(0.5))
        score = score * penalty.otherwise(num(1))
    return wide.select(*sets.columns, score.alias("score"))


def rank_palettes(scored: DataFrame, keys: list[str], first: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Best palettes of a key, near copies of better ones left out: keys, palettes (arrays of Lab structs, light to dark).

    One image has at most a few thousand sets. They are folded in score order
    and the fold stops taking palettes at the limit, if one is given. `first` (keys, inks) leads.
    """
    inks = F.transform("set", lambda s: F.struct(s["l"].alias("l"), s["a"].alias("a"), s["b"].alias("b")))
    light_first = F.reverse(F.array_sort(inks))
    rows = scored.select(*keys, (-F.col("score")).alias("_k"), "ids", light_first.alias("inks"))
    lists = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_k", "ids", "inks"))).alias("_sets"))
    empty = F.transform(F.filter("_sets", lambda _: F.lit(False)), lambda s: s["inks"])
    if first is not None:
        lists = lists.join(first.select(*keys, F.array("inks").alias("_first")).hint("merge"), keys, "left")
        start = F.coalesce(F.col("_first"), empty)
    else:
        start = empty

    def same(p: Column, q: Column) -> Column:
        close = F.zip_with(p, q, lambda x, y: C.distance2((x["l"], x["a"], x["b"]), (y["l"], y["a"], y["b"])) < SAME_COLOR * SAME_COLOR)
        return (F.size(p) == F.size(q)) & F.forall(close, lambda c: c)

    def keep(out: Column, s: Column) -> Column:
        seen = F.exists(out, lambda p: same(p, s["inks"]))
        full = F.size(out) >= limit if limit else F.lit(False)
        return F.when(full | seen, out).otherwise(F.concat(out, F.array(s["inks"])))

    return lists.select(*keys, F.aggregate("_sets", start, keep).alias("palettes"))


def choose_palette(candidates: DataFrame, keys: list[str], inks: int, style: str, variant: int = 0, first: DataFrame | None = None) -> DataFrame:
    """The wanted one of the best MAX_PALETTES sets of `inks` candidates of every image: keys, inks (Lab structs, light to dark).

    `candidates`: keys, id, share, l, a, b, a few dozen an image. `variant` counts through the ranked palettes and starts
    again after the last. An image with fewer candidates than inks ranks sets of all it has. `first` (keys, inks) leads.
    """
    takes = candidates.groupBy(*keys).agg(F.least(F.lit(inks), F.count("*")).alias("_take"))
    sized = cut_lineage(candidates.join(takes.hint("merge"), keys))
    sets = None
    for n in range(1, inks + 1):
        part = score_sets(combinations(sized.where(F.col("_take") == n).drop("_take"), keys, n), keys, style, n)
        part = part.withColumn("score", F.round("score", 9))
        sets = part if sets is None else sets.unionByName(part)
    ranked = rank_palettes(sets, keys, first, MAX_PALETTES)
    at = F.pmod(F.lit(variant), F.greatest(F.size("palettes"), F.lit(1)))
    return ranked.select(*keys, F.get("palettes", at).alias("inks"))


def next_ink(inks: DataFrame, keys: list[str]) -> DataFrame:
    """First offered colour a palette does not use yet (black when all are used): keys, hex."""
    used = inks.groupBy(*keys).agg(F.collect_set(F.lower("hex")).alias("_used"))  # at most four inks
    free = F.filter(F.array(*[F.lit(h) for h in NEW_INKS]), lambda h: ~F.array_contains("_used", h))
    return used.select(*keys, F.coalesce(F.get(free, F.lit(0)), F.lit("#000000")).alias("hex"))


def auto_palette(
    points: DataFrame, keys: list[str], inks: int, paper_hex: str | None, style: str = "balanced", vividness: float = 0.0, variant: int = 0, images: DataFrame | None = None
) -> DataFrame:
    """Palette of every image: keys, inks (hexes, light to dark), paper.

    `images` (keys), if given, names the images to answer for; those without points get black inks.

    `points`: keys, pid, l, a, b. Clusters the pixels (the paper pinned if it is
    kept), turns clusters into candidate colours, ranks their combinations and
    takes the wanted one.
    """
    points = cut_lineage(points.select(*keys, "pid", *LAB))
    keep = paper_hex is not None
    fixed = None
    if keep:
        fixed = points.select(*keys).distinct().select(*keys, *[c.alias(n) for c, n in zip(C.rgb_to_lab(C.hex_to_rgb(F.lit(paper_hex))), LAB)])

    def clustered(rows: DataFrame, k: int, pinned: DataFrame | None, seed: int) -> tuple[DataFrame, DataFrame]:
        centers = best_clustering(rows, keys, k, pinned, seed)
        return centers, cut_lineage(nearest_center(rows, centers, keys))

    def papers_of(centers: DataFrame) -> DataFrame:
        pick = F.max_by(F.struct(*LAB), F.when(F.col("fixed"), num(1e9)).otherwise(F.col("l")))
        return centers.groupBy(*keys).agg(pick.alias("p")).select(*keys, *[F.col(f"p.{c}").alias(f"p_{c}") for c in LAB])

    def strongest(assigned: DataFrame, papers: DataFrame) -> DataFrame:
        far = assigned.join(papers, keys)
        return top_share_avg(far, [*keys, "cluster"], C.distance2(lab_of(), lab_of("p_")))

    def light_to_dark(rows: DataFrame) -> DataFrame:
        packed = rows.groupBy(*keys).agg(F.reverse(F.array_sort(F.collect_list(F.struct(*LAB)))).alias("inks"))
        return packed

    base_centers, base = clustered(points, inks + 1, fixed, 1)
    base_papers = papers_of(base_centers)
    lightest = base_centers.groupBy(*keys).agg(F.max_by("cluster", F.struct("l", -F.col("cluster"))).alias("_lightest"))
    inked_centers = base_centers.join(lightest, keys).where(~F.col("fixed") if keep else F.col("cluster") != F.col("_lightest"))
    strong_base = strongest(base, base_papers).withColumnsRenamed({c: f"_{c}" for c in LAB})
    # A cluster without members keeps its centre as its colour.
    own = inked_centers.join(strong_base, [*keys, "cluster"], "left").select(*keys, *[F.coalesce(f"_{c}", c).alias(c) for c in LAB])
    original = light_to_dark(own)
    papers, chosen = base_papers, original
    if style != "balanced" or variant:
        centers, assigned = clustered(points, 13, fixed, 101)
        papers = papers_of(centers)
        shares = cluster_share(assigned, centers, keys, keep)
        inked = shares.groupBy(*keys).agg(F.sum(F.when(~F.col("is_paper"), F.col("n")).otherwise(0)).alias("_inked"))
        strong = strongest(assigned, papers)
        vivid = top_share_avg(assigned, [*keys, "cluster"], C.chroma(lab_of()))
        pick = vivid if style == "vibrant" else strong
        named = vivid.withColumnsRenamed({c: f"v_{c}" for c in LAB})
        main = shares.where(~F.col("is_paper")).join(pick, [*keys, "cluster"]).join(named, [*keys, "cluster"])
        bright = cut_lineage(colorful(points, keys))
        squashed, members = clustered(bright, 8, None, 211)
        members = members.withColumn("l", F.col("l") * 2)
        counts = members.groupBy(*keys, "cluster").agg(F.count("*").alias("n")).join(inked, keys)
        extra_pick = top_share_avg(members, [*keys, "cluster"], C.chroma(lab_of())) if style == "vibrant" else strongest(members, papers)
        extra_named = top_share_avg(members, [*keys, "cluster"], C.chroma(lab_of())).withColumnsRenamed({c: f"v_{c}" for c in LAB})
        extra = counts.join(extra_pick, [*keys, "cluster"]).join(extra_named, [*keys, "cluster"])
        extra = extra.select(*keys, (F.col("cluster") + 100).alias("id"), (F.col("n") / F.greatest(F.col("_inked"), F.lit(1))).alias("share"), *LAB, *[f"v_{c}" for c in LAB])
        main = main.select(*keys, F.col("cluster").alias("id"), "share", *LAB, *[f"v_{c}" for c in LAB])
        by_vivid = lambda df: df.select(*keys, "id", *[F.col(f"v_{c}").alias(c) for c in LAB])
        kept = dedupe_near(by_vivid(main), by_vivid(extra), keys).select(*keys, "id")
        cands = cut_lineage(main.unionByName(extra).join(kept, [*keys, "id"], "left_semi").select(*keys, "id", "share", *LAB))
        found = choose_palette(cands, keys, inks, style, variant, original if style == "balanced" else None)
        # Without any candidate the plain clusters serve.
        chosen = original.join(found.withColumnRenamed("inks", "_found"), keys, "left").select(*keys, F.coalesce("_found", "inks").alias("inks"))
    amount = 1 - (1 - 0.4) * (1 - vividness) if style == "vibrant" else vividness
    padded = F.concat("inks", F.array_repeat(F.element_at("inks", -1), inks)) if inks else F.col("inks")
    slots = chosen.select(*keys, F.posexplode(F.slice(padded, 1, inks)).alias("slot", "ink"))
    moved = C.vivid((F.col("ink.l"), F.col("ink.a"), F.col("ink.b")), amount) if amount > 0 else tuple(F.col(f"ink.{c}") for c in LAB)
    slots = slots.select(*keys, "slot", *[c.alias(n) for c, n in zip(moved, LAB)])
    hexes = slots.select(*keys, F.struct((-F.col("l")).alias("k"), F.col("slot"), C.rgb_to_hex(C.lab_to_rgb(lab_of())).alias("hex")).alias("s"))
    packed = hexes.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["hex"]).alias("inks"))
    paper = F.lit(paper_hex) if keep else C.rgb_to_hex(C.lab_to_rgb(lab_of("p_")))
    out = packed.join(papers.select(*keys, paper.alias("paper")), keys)
    if images is None:
        return out
    black = F.array_repeat(F.lit("#000000"), inks)
    return images.select(*keys).distinct().join(out, keys, "left").select(*keys, F.coalesce("inks", black).alias("inks"), F.coalesce("paper", F.lit(paper_hex or "#ffffff")).alias("paper"))


def tone_error(dots: DataFrame, cov: DataFrame, keys: list[str]) -> DataFrame:
    """Mean inked share against mean coverage of every patch: keys, inked, wanted, error."""
    a = dots.groupBy(*keys).agg(F.avg(F.col("on").cast("double")).alias("inked"))
    b = cov.groupBy(*keys).agg(F.avg("c").alias("wanted"))
    return a.join(b, keys).select(*keys, "inked", "wanted", (F.col("inked") - F.col("wanted")).alias("error"))

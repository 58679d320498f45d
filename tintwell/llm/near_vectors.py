"""Near vectors by a robust-pruned flat graph, built on overlapping cluster shards and searched by range."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintwell.llm.common import components, written

#: Least cosine of a link, and how far below it the search still walks on.
LEAST, SLACK = 0.95, 0.03
#: Vectors a shard aims at, most in a part of it, rows the centres are fitted on (a bounded sample; every row is indexed), and rounds of fitting.
SHARD, PART, SAMPLE, FITS = 400, 3000, 20_000, 4
#: Shards a vector is built into.
OVERLAP = 3
#: Neighbours kept per vector, nearest and random candidates they are picked from, and the pruning factor.
DEGREE, NEAREST, RANDOM, ALPHA = 24, 64, 32, 1.2
#: Width of the greedy search.
BEAM = 12
#: Vectors that start a search together, and visitors of a part in one task.
TOGETHER, VISITORS = 512, 8192
#: Queries whose links are counted by comparison with all vectors, and the share of them that must be found.
AUDITED, RECALL = 256, 0.99
#: Overlap from which the index is not built wider, and the share that it must find even so.
WIDEST, RECALL_LEAST = 16, 0.9


def _matrix(column) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.float64) for x in column]) if len(column) else np.zeros((0, 0))


def directions(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and unit vector in double precision (null for vectors that link with nothing)."""

    def run(batches):
        for batch in batches:
            out = []
            for x in batch["v"]:
                v = None if x is None else np.array([np.nan if c is None else c for c in x], dtype=np.float64)
                norm = np.linalg.norm(v) if v is not None and len(v) and np.isfinite(v).all() else 0.0
                # Scaled first, so that very large or small components neither overflow nor vanish.
                if norm == 0 or not np.isfinite(norm):
                    top = np.abs(v).max() if v is not None and len(v) and np.isfinite(v).all() else 0.0
                    v, norm = (v / top, np.linalg.norm(v / top)) if top > 0 else (None, 0.0)
                out.append((v / norm).tobytes() if norm else None)
            yield pd.DataFrame({"vec_id": batch["vec_id"].astype("Int64"), "unit": out})

    rows = vectors.select(F.col(id_col).cast("string").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    return rows.mapInPandas(run, "vec_id long, unit binary")


def _centres(units: DataFrame, count: int) -> list[np.ndarray]:
    """Centres of each length of vector, fitted on at most SAMPLE rows with the smallest hashes."""
    share = min(1.0, SAMPLE / max(1, count))
    rows = units.where(F.pmod(F.xxhash64("unit"), F.lit(1 << 30)) < int(share * (1 << 30))).select("unit").limit(2 * SAMPLE).toPandas()
    out = []
    for size in sorted({len(x) for x in rows["unit"]}):
        x = _matrix([u for u in rows["unit"] if len(u) == size])
        k = max(1, min(len(x), round(count * len(x) / max(1, len(rows)) / SHARD)))
        c = x[np.random.default_rng(1).permutation(len(x))[:k]]
        for _ in range(FITS):
            own = (x @ c.T).argmax(axis=1)
            sums = np.zeros_like(c)
            np.add.at(sums, own, x)
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            c = np.where(norm > 0, sums / np.maximum(norm, 1e-300), c)
        out.append(c)
    return out


def _shards(units: DataFrame, centres: list[np.ndarray], overlap: int) -> DataFrame:
    """vec_id, unit, weight and the `overlap` nearest shards of each distinct vector."""

    def run(batches):
        for batch in batches:
            shards = [None] * len(batch)
            base = 0
            sizes = np.array([len(u) // 8 for u in batch["unit"]])
            for c in centres:
                at = np.flatnonzero(sizes == c.shape[1])
                for a in range(0, len(at), 2048):
                    part = at[a : a + 2048]
                    near = np.argsort(-(_matrix(batch["unit"].iloc[part]) @ c.T), axis=1, kind="stable")[:, :overlap]
                    for i, row in zip(part, near):
                        shards[i] = row.astype(np.int64) + base
                base += len(c)
            # A length that the sample lacks has a shard of its own.
            yield batch.assign(shards=[np.array([-int(n)]) if x is None else x for x, n in zip(shards, sizes)])

    return units.mapInPandas(run, "unit binary, vec_id long, weight long, shards array<long>")


def _members(shards: DataFrame) -> DataFrame:
    """vec_id, unit, weight, home and part: each vector in each of its parts, home being its part of the nearest shard.

    A shard of more than PART vectors, as around one much-copied vector, is cut by hash. Its second and later
    members are cut by another hash, so that parts of one shard overlap in random vectors.
    """
    each = shards.select("vec_id", "unit", "weight", F.posexplode("shards").alias("rank", "shard"))
    cuts = each.groupBy("shard").agg(F.ceil(F.count("*") / PART).cast("int").alias("cuts"))
    each = each.join(cuts, "shard").withColumn("part", F.xxhash64("shard", F.pmod(F.xxhash64("vec_id", "rank"), F.col("cuts"))))
    home = each.where("rank = 0").select("vec_id", F.col("part").alias("home"))
    return each.select("vec_id", "unit", "weight", "part").distinct().join(home, "vec_id")


def _robust_prune(pool: np.ndarray, dist: np.ndarray) -> np.ndarray:
    """For each row of `pool` (candidates of a vector), the neighbours kept, padded with -1.

    The closest candidate is kept, and those that it is nearer to than the vector is by the factor ALPHA are struck
    out, again and again.
    """
    n = len(pool)
    rows = np.arange(n)
    far = np.take_along_axis(dist, pool, axis=1)
    far[pool == rows[:, None]] = np.inf
    kept = np.full((n, DEGREE), -1, dtype=np.int64)
    left = far.copy()
    for k in range(DEGREE):
        best = left.argmin(axis=1)
        live = np.isfinite(left[rows, best])
        if not live.any():
            break
        pick = pool[rows, best]
        kept[live, k] = pick[live]
        left[(ALPHA * dist[pick[:, None], pool] <= far) | (pool == pick[:, None])] = np.inf
    return kept


def _build(x: np.ndarray) -> list[np.ndarray]:
    """Neighbours of each vector of a part: its pruned candidates, and the nearest of those that keep it."""
    n = len(x)
    dist = np.sqrt(np.maximum(0, 2 - 2 * (x @ x.T)))
    medoid = _medoid(x)
    m = min(NEAREST, n)
    # Random candidates and the medoid give the long edges that a walk from the medoid needs.
    pool = np.concatenate([np.argpartition(dist, m - 1, axis=1)[:, :m], np.random.default_rng(n).integers(0, n, (n, min(RANDOM, n))), np.full((n, 1), medoid)], axis=1)
    kept = _robust_prune(pool, dist)
    a, b = np.nonzero(kept >= 0)
    own, other = a, kept[a, b]
    order = np.lexsort((dist[other, own], other))
    back = np.split(own[order], np.cumsum(np.bincount(other, minlength=n))[:-1])
    return [np.union1d(k[k >= 0], r[:DEGREE]) for k, r in zip(kept, back)]


def _medoid(x: np.ndarray) -> int:
    return int((x @ x.sum(axis=0)).argmax())


def graph(members: DataFrame) -> DataFrame:
    """vec_id, unit, weight, home, and the united neighbour lists of the vector's parts: their ids, homes and cosines."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id")
        ids, home, x = rows["vec_id"].to_numpy(np.int64), rows["home"].to_numpy(np.int64), _matrix(rows["unit"])
        near = _build(x)
        return pd.DataFrame({"vec_id": ids, "to": [ids[n] for n in near], "to_home": [home[n] for n in near], "cosine": [x[n] @ v for n, v in zip(near, x)]})

    lists = members.groupBy("part").applyInPandas(build, "vec_id long, to array<long>, to_home array<long>, cosine array<double>")
    lists = lists.groupBy("vec_id").agg(F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("to", "to_home", "cosine")))).alias("edges"))
    lists = lists.select("vec_id", F.col("edges.to").alias("to"), F.col("edges.to_home").alias("to_home"), F.col("edges.cosine").alias("cosine"))
    return members.select("vec_id", "unit", "weight", "home").distinct().join(lists, "vec_id")


class Region:
    """The vectors at home in a part, with their edges inside it and those that leave it."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values("vec_id")
        self.ids, self.x, self.weight = rows["vec_id"].to_numpy(np.int64), _matrix(rows["unit"]), rows["weight"].to_numpy(np.int64)
        home = rows["home"].iloc[0]
        degree = np.array([len(t) for t in rows["to"]])
        own = np.repeat(np.arange(len(rows)), degree)
        to, to_home, cosine = (np.concatenate(rows[c].to_list()) if degree.sum() else np.zeros(0) for c in ("to", "to_home", "cosine"))
        inside = to_home == home
        place = np.searchsorted(self.ids, to[inside].astype(np.int64))
        self.near = _padded(own[inside], place, len(rows))
        # Of the edges that leave, the closest one to each other part is enough.
        leave = pd.DataFrame({"own": own[~inside], "part": to_home[~inside].astype(np.int64), "end": to[~inside].astype(np.int64), "cosine": cosine[~inside]})
        leave = leave.sort_values(["own", "part", "cosine"]).drop_duplicates(["own", "part"], keep="last")
        self.leave_from, self.leave_to, self.leave_end = (leave[c].to_numpy(np.int64) for c in ("own", "part", "end"))
        self.leave_angle = np.arccos(np.clip(leave["cosine"].to_numpy(np.float64), -1, 1))
        self.medoid = _medoid(self.x)

    def greedy(self, q: np.ndarray, beam: int) -> np.ndarray:
        """The `beam` closest vectors that a best-first walk from the medoid finds for each query, -1 for none."""
        n = len(q)
        seen = np.zeros((n, len(self.x)), dtype=bool)
        ids, sims = np.full((n, beam), -1), np.full((n, beam), -np.inf)
        done = np.ones((n, beam), dtype=bool)
        ids[:, 0], sims[:, 0], done[:, 0], seen[:, self.medoid] = self.medoid, q @ self.x[self.medoid], False, True
        while True:
            best = np.where(done, -np.inf, sims).argmax(axis=1)
            at = np.flatnonzero(~done[np.arange(n), best])
            if not len(at):
                return ids
            done[at, best[at]] = True
            near = self.near[ids[at, best[at]]]
            fresh = (near >= 0) & ~seen[at[:, None], near]
            seen[np.repeat(at, fresh.sum(axis=1)), near[fresh]] = True
            sim = np.where(fresh, np.einsum("nd,nkd->nk", q[at], self.x[near]), -np.inf)
            all_ids, all_sims = np.concatenate([ids[at], near], axis=1), np.concatenate([sims[at], sim], axis=1)
            all_done = np.concatenate([done[at], ~fresh], axis=1)
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[at], sims[at], done[at] = (np.take_along_axis(v, top, axis=1) for v in (all_ids, all_sims, all_done))

    def in_range(self, q: np.ndarray, start: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, pd.DataFrame]:
        """All (query, vector) with a cosine of `least` or more that a walk over vectors in or near the range reaches.

        Also the parts that edges from there lead to, if their ends can be in range, with the end that must be closest.
        """
        n, m = len(q), len(self.x)
        seen = np.zeros(n * m, dtype=bool)
        reach = np.arccos(least)
        pairs, parts = [], []
        fresh = start
        while len(fresh):
            found = []
            for a in range(0, len(fresh), 65536):
                flat = np.unique(fresh[a : a + 65536])
                flat = flat[~seen[flat]]
                seen[flat] = True
                sim = np.einsum("nd,nd->n", q[flat // m], self.x[flat % m])
                pairs.append(flat[sim >= least])
                walk = sim >= least - SLACK
                found.append((flat[walk], np.arccos(np.clip(sim[walk], -1, 1))))
            fresh = []
            for flat, angle in found:
                for a in range(0, len(flat), 16384):
                    own, node = flat[a : a + 16384] // m, flat[a : a + 16384] % m
                    near = self.near[node]
                    to = (own[:, None] * m + near)[near >= 0]
                    fresh.append(np.unique(to[~seen[to]]))
                    lo, hi = np.searchsorted(self.leave_from, node), np.searchsorted(self.leave_from, node, side="right")
                    e = _spans(lo, hi)
                    # The end of an edge is out of range when the edge is longer than the way there and the range together.
                    can = self.leave_angle[e] <= np.repeat(angle[a : a + 16384], hi - lo) + reach
                    way = np.repeat(angle[a : a + 16384], hi - lo)[can] + self.leave_angle[e][can]
                    on = pd.DataFrame({"own": np.repeat(own, hi - lo)[can], "part": self.leave_to[e][can], "end": self.leave_end[e][can], "way": way})
                    parts.append(on.sort_values("way").drop_duplicates(["own", "part"]))
            fresh = np.unique(np.concatenate(fresh)) if fresh else np.zeros(0, np.int64)
        flat = np.concatenate(pairs) if pairs else np.zeros(0, np.int64)
        on = pd.concat(parts).sort_values("way").drop_duplicates(["own", "part"]) if parts else pd.DataFrame({"own": [], "part": [], "end": []}, dtype=np.int64)
        return flat // m, flat % m, on

    def search(self, q_ids: np.ndarray, q: np.ndarray, entry: np.ndarray, least: float, beam: int) -> pd.DataFrame:
        """Per query: weight of the vectors linked here, the smallest id connected here, and the parts to go on to.

        The walk starts from what the greedy search from the medoid finds and from `entry`, a vector at home here.

        Vectors found are listed too, with no weight, so that their class is known even if no link is counted for them.
        """
        none = np.zeros(0, np.int64)
        links, parts, ends, a_all, b_all = np.zeros(len(q), np.int64), [none] * len(q), [none] * len(q), [], []
        for at in range(0, len(q), TOGETHER):
            part, own = q[at : at + TOGETHER], q_ids[at : at + TOGETHER]
            found = self.greedy(part, beam)
            i, k = np.nonzero(found >= 0)
            start = i * len(self.x) + found[i, k]
            enter = np.searchsorted(self.ids, entry[at : at + TOGETHER])
            a, b, on = self.in_range(part, np.concatenate([start, np.arange(len(part)) * len(self.x) + enter]), least)
            other = self.ids[b] != own[a]
            a, b = a[other], b[other]
            links[at : at + TOGETHER] = np.bincount(a, weights=self.weight[b], minlength=len(part)).astype(np.int64)
            for i, group in on.groupby("own"):
                parts[at + i], ends[at + i] = group["part"].to_numpy(np.int64), group["end"].to_numpy(np.int64)
            a_all.append(own[a])
            b_all.append(self.ids[b])
        nodes, label = _classes(np.concatenate(a_all), np.concatenate(b_all)) if a_all else (none, none)
        low = q_ids.copy()
        place = np.minimum(np.searchsorted(nodes, q_ids), max(0, len(nodes) - 1))
        if len(nodes):
            low = np.where(nodes[place] == q_ids, label[place], q_ids)
        extra = ~np.isin(nodes, q_ids)
        rows = pd.DataFrame({"vec_id": q_ids, "links": links, "low": low, "parts": parts, "ends": ends})
        more = pd.DataFrame({"vec_id": nodes[extra], "links": 0, "low": label[extra], "parts": [none] * int(extra.sum()), "ends": [none] * int(extra.sum())})
        return pd.concat([rows, more])


def _padded(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Values of each row beside each other, padded with -1. Rows come in order."""
    degree = np.bincount(row, minlength=n)
    out = np.full((n, max(1, int(degree.max(initial=0)))), -1, dtype=np.int64)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(degree) - degree, degree)] = value
    return out


def _spans(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    n = hi - lo
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def _classes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links and the smallest node each is connected with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _search_rounds(nodes: DataFrame, units: DataFrame, least: float, beam: int) -> DataFrame:
    """vec_id, links, low of every vector in every part it was searched in. Each goes through a part once."""
    schema = "vec_id long, links long, low long, parts array<long>, ends array<long>"

    def at_home(rows: pd.DataFrame) -> pd.DataFrame:
        region = Region(rows)
        return region.search(region.ids, region.x, region.ids, least, beam)

    def visitors(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or queries.empty:
            return pd.DataFrame({"vec_id": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "low": np.zeros(0, np.int64), "parts": [], "ends": []})
        queries = queries.sort_values("vec_id")
        return Region(rows).search(queries["vec_id"].to_numpy(np.int64), _matrix(queries["unit"]), queries["entry"].to_numpy(np.int64), least, beam)

    out = written(nodes.groupBy("home").applyInPandas(at_home, schema), "found")
    been = nodes.select("vec_id", F.col("home").alias("part"))
    last = out
    while True:
        go = last.select("vec_id", F.explode(F.arrays_zip("parts", "ends")).alias("x")).groupBy("vec_id", F.col("x.parts").alias("part")).agg(F.min("x.ends").alias("entry"))
        go = written(go.join(been, ["vec_id", "part"], "left_anti"), "visits")
        if go.isEmpty():
            return out.select("vec_id", "links", "low")
        been = been.unionByName(go.drop("entry"))
        # A part with many visitors takes them in several tasks.
        tasks = written(go.groupBy("part").agg(F.ceil(F.count("*") / VISITORS).cast("int").alias("tasks")), "tasks")
        asked = go.join(tasks, "part").withColumn("task", F.pmod(F.xxhash64("vec_id"), F.col("tasks")).cast("int")).join(units, "vec_id").select("vec_id", "unit", "entry", F.col("part").alias("home"), "task")
        hosts = nodes.join(tasks.withColumnRenamed("part", "home"), "home").withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
        last = hosts.groupBy("home", "task").cogroup(asked.groupBy("home", "task")).applyInPandas(visitors, schema)
        last = written(last, "found")
        out = out.unionByName(last)


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = LEAST, overlap: int = OVERLAP, beam: int = BEAM, recall: float = RECALL
) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row per input row.

    Equal directions are one vector with a weight. Distinct ones are built into a graph part by part and united, then
    each searches its home part from the medoid, walks on over what is in range, and visits the parts that edges from
    there lead to. Cosines are in double precision. A bounded set of queries is compared with all vectors; when too few
    of their links were found, the index is built again with twice the overlap and beam. Every build is audited; when the
    widest one finds fewer than RECALL_LEAST of the links, the call fails and says how many it found.

    Null, empty, zero and non-finite vectors have no links, vectors of different lengths, however long, have none with
    each other. A vector without an id links with nothing and is a class of its own, as no link could name it. A cosine of
    exactly the least value links, so ties are links; a class is named by its smallest id. Rows that repeat an id add up,
    an empty table gives no rows, other columns, whatever their names, are ignored.
    """
    rows = written(directions(vectors, id_col, vec_col), "directions")
    units = rows.where("unit IS NOT NULL AND vec_id IS NOT NULL").groupBy("unit").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"))
    units = written(units.select("unit", "vec_id", "weight"), "units")
    count = units.count()
    centres = _centres(units, count)
    while True:
        nodes = written(graph(written(_members(_shards(units, centres, overlap)), "members")), "graph")
        found = written(_search_rounds(nodes, units, least, beam), "links")
        links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
        met = audit(units, links, least)
        if met >= recall:
            break
        if overlap >= WIDEST:
            if met < RECALL_LEAST:
                raise RuntimeError(f"the widest index meets only {met:.3f} of the links that the audit knows")
            break
        overlap, beam = 2 * overlap, 2 * beam
    classes = components(found.where("vec_id <> low").select(F.col("vec_id").alias("a"), F.col("low").alias("b")))
    per_unit = units.join(links, "vec_id").join(classes.select(F.col("node").alias("vec_id"), "component"), "vec_id", "left")
    per_unit = per_unit.select("unit", (F.col("links") + F.col("weight") - 1).alias("links"), F.coalesce("component", "vec_id").alias("component"))
    out = rows.alias("r").join(per_unit.alias("u"), F.expr("r.unit = u.unit AND r.vec_id IS NOT NULL"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def audit(units: DataFrame, links: DataFrame, least: float = LEAST, queries: int = AUDITED) -> float:
    """Share of the true links that `links` (vec_id, links) has for a bounded number of queries, compared with all vectors in blocks."""
    total = max(1, units.count())
    share = min(1 << 30, int(queries / total * (1 << 30)) + 1)
    asked = units.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < share).limit(2 * queries).toPandas()
    ids = asked["vec_id"].to_numpy(np.int64)
    by_size = {n: np.array([i for i, u in enumerate(asked["unit"]) if len(u) == n]) for n in {len(u) for u in asked["unit"]}}
    sides = {n: (at, _matrix(asked["unit"].iloc[at])) for n, at in by_size.items()}

    def run(batches):
        sums = np.zeros(len(ids), dtype=np.int64)
        for batch in batches:
            sizes = np.array([len(u) for u in batch["unit"]])
            for n, (at, q) in sides.items():
                own = np.flatnonzero(sizes == n)
                for a in range(0, len(own), 2048):
                    part = batch.iloc[own[a : a + 2048]]
                    hit = (_matrix(part["unit"]) @ q.T >= least) & (part["vec_id"].to_numpy()[:, None] != ids[at][None, :])
                    sums[at] += (hit * part["weight"].to_numpy()[:, None]).sum(axis=0)
        yield pd.DataFrame({"vec_id": ids, "truth": sums})

    truth = units.mapInPandas(run, "vec_id long, truth long").groupBy("vec_id").agg(F.sum("truth").alias("truth"))
    got, true = truth.join(links, "vec_id").agg(F.sum(F.least("links", "truth")), F.sum("truth")).first()
    return got / true if true else 1.0

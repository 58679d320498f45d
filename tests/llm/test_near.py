"""Near copies of texts and vectors, against comparison of all pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm.conftest import COLUMNS, ODD, prose, rows_of
from tintwell.llm import common, minhash, near_vectors


def classes_of(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    ids = sorted(i for i in sets if sets[i])
    links = []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            inter = len(sets[a] & sets[b])
            if 100 * inter >= 85 * (len(sets[a]) + len(sets[b]) - inter):
                links.append((a, b))
    return sets, links


def edited(text, n, seed):
    rng = random.Random(seed)
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


def test_components_of_chains_stars_and_single_links(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(2, 60)] + [(500, 400), (400, 500), (7, 7), (60, 59)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 61)}, **{k: 100 for k in range(100, 161)}, 400: 400, 500: 400}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_classes_against_all_pairs(spark):
    texts, at = {}, 0
    # Groups of edited copies, so that links form chains, with pairs on both sides of the threshold.
    for g in range(12):
        base = prose(100 + g, 160)
        for k in range(30):
            texts[at] = edited(base, k % 6, at)
            at += 1
    for k in range(60):
        texts[at] = prose(1000 + k, 3 + k)
        at += 1
    docs = spark.createDataFrame(rows_of((i, t, "en", "a") for i, t in texts.items()), COLUMNS).repartition(4)
    got = {r.doc_id: r for r in minhash.near_classes(docs).collect()}
    sets, links = near(texts)
    want = classes_of(texts, links)
    assert all(got[i].n_shingles == len(sets[i]) for i in texts)
    # 0.9990 of links at the threshold are met; of more similar ones nearly all.
    assert sum(got[i].component_id == want[i] for i in texts) >= 0.99 * len(texts)
    assert all(got[i].kept == (got[i].component_id == i) for i in texts)


def test_blocks_find_what_pairs_find(spark, monkeypatch):
    base = prose(5, 120)
    texts = {i: edited(base, 6 + i % 5, i) for i in range(150)} | {i: edited(prose(6, 120), i % 3, i) for i in range(150, 200)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(minhash, "PAIRS_PER_ROW", 0)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    got = {r.doc_id: r.component_id for r in minhash.near_classes(docs).collect()}
    want = classes_of(texts, near(texts)[1])
    assert sum(got[i] == want[i] for i in texts) >= 0.98 * len(texts)


def test_near_classes_of_awkward_rows(odd, none):
    rows = minhash.near_classes(odd).collect()
    assert len(rows) == len(ODD)
    got = {r.doc_id: r for r in rows}
    assert [got[i].n_shingles for i in (1, 2, 3)] == [0, 0, 0] and all(got[i].component_id == i for i in (1, 2, 3))
    assert got[4].component_id == got[5].component_id == 4
    assert got[6].component_id == got[7].component_id == got[8].component_id == 6
    assert got[11].component_id == 10 and got[None].component_id is None and got[14].n_shingles == 1
    assert minhash.near_classes(none).count() == 0


def test_common_counts_are_intersections():
    rng = np.random.default_rng(0)
    a = [np.unique(rng.integers(0, 9000, n).astype(np.uint32)) for n in (0, 5, 800, 4000)]
    b = [np.unique(rng.integers(0, 9000, n).astype(np.uint32)) for n in (1, 900, 5000)]
    assert (minhash._common_counts(a, b) == [[len(np.intersect1d(x, y)) for y in b] for x in a]).all()


def vectors_of(seed, groups, size, dim=32):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        c = rng.normal(size=dim)
        out += [c / np.linalg.norm(c) + rng.normal(size=dim) * rng.choice([0.02, 0.04, 0.06]) for _ in range(rng.integers(1, size))]
    return out


def check_vectors(rows, vectors):
    x = np.array([v / np.linalg.norm(v) for v in vectors.values()], dtype=float)
    ids = np.array(list(vectors))
    hit = (x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    want = classes_of(ids.tolist(), [(ids[a], ids[b]) for a, b in zip(*np.nonzero(hit)) if a < b])
    got = {r.vec_id: r for r in rows}
    links = dict(zip(ids.tolist(), hit.sum(axis=1).tolist()))
    assert all(got[i].n_links <= links[i] for i in links), "a link below the threshold"
    assert sum(got[i].n_links for i in links) >= 0.99 * sum(links.values())
    assert sum(got[i].component_id == want[i] for i in links) >= 0.99 * len(links)
    assert all(r.kept == (r.component_id == r.vec_id) for r in rows)


def test_near_vectors_against_all_pairs(spark):
    vectors = dict(enumerate(vectors_of(1, 250, 16)))
    hot = vectors_of(2, 1, 3)[0]
    rng = np.random.default_rng(3)
    # A third are one vector or close to it, many of them equal.
    vectors |= {5000 + i: hot if i % 2 else hot + rng.normal(size=32) * 0.02 for i in range(len(vectors) // 2)}
    df = spark.createDataFrame([(i, [float(c) for c in v], 0, "clash", 1) for i, v in vectors.items()], "vec_id long, embedding array<double>, label int, unit string, home long").repartition(4)
    check_vectors(near_vectors.near_vectors(df).collect(), vectors)


def test_near_vectors_over_cut_parts(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "SHARD", 60)
    monkeypatch.setattr(near_vectors, "PART", 100)
    monkeypatch.setattr(near_vectors, "VISITORS", 40)
    vectors = dict(enumerate(vectors_of(4, 60, 20) + [np.ones(32) + np.random.default_rng(k).normal(size=32) * 0.1 for k in range(300)]))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in vectors.items()], "vec_id long, embedding array<double>")
    check_vectors(near_vectors.near_vectors(df).collect(), vectors)


def test_near_vectors_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [1e-300, 0.0]), (11, [0.0, 1e300]), (12, [0.0, 1.0]), (None, [1.0, 0.0]), (None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = near_vectors.near_vectors(df).collect()
    assert len(out) == len(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in out if r.vec_id is not None}
    assert all(got[i] == (0, i) for i in range(1, 7))
    assert got[7] == (2, 7) and got[8] == (2, 7) and got[10] == (2, 7) and got[11] == (1, 11) and got[12] == (1, 11) and got[9] == (1, 9)
    assert near_vectors.near_vectors(df.where("vec_id < 0")).count() == 0
    assert near_vectors.near_vectors(df.where("vec_id < 4")).where(F.col("n_links") > 0).count() == 0


def test_bitmap_keeps_all_that_are_wanted_and_few_others(spark):
    rows = spark.range(-20_000, 40_000).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("key"))
    rows = rows.unionByName(rows.where("doc_id = 1")).unionByName(spark.sql("SELECT CAST(NULL AS LONG) doc_id, CAST(NULL AS LONG) key"))
    wanted = rows.where("doc_id % 37 = 0 OR doc_id IS NULL")
    for col in ("doc_id", "key"):
        got = minhash._perhaps_in(rows, wanted, col)
        assert wanted.where("doc_id IS NOT NULL").exceptAll(got).isEmpty()
        assert got.count() < wanted.count() + 100
        assert minhash._perhaps_in(rows, wanted.limit(0), col).isEmpty()


def test_sketches_never_rule_out_what_is_shared():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 2**63, 6000, dtype=np.uint64)
    for na, nb, common in [(1, 1, 1), (1, 1, 0), (1, 9, 1), (255, 257, 250), (300, 500, 300), (1000, 1100, 700), (2049, 2040, 1900)]:
        a, b = pool[:na], pool[na - common : na - common + nb]
        most = minhash._most_common(na, minhash._sketch(a), nb, minhash._sketch(b))
        assert common <= most <= common + 0.35 * (min(na, nb) - common) + 1


def test_sets_travel_only_for_pairs_that_may_be_near(spark, monkeypatch):
    # Texts of the first kind share keys by chance and few of them are near.
    base = prose(9, 300)
    texts = {i: edited(base, 12, i) for i in range(120)} | {200 + i: edited(prose(10, 300), i % 2, i) for i in range(20)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    seen, confirmed = [], minhash._confirmed

    def spy(pairs, sets, percent):
        seen.extend((r.a, r.b) for r in pairs.collect())
        return confirmed(pairs, sets, percent)

    monkeypatch.setattr(minhash, "_confirmed", spy)
    got = {r.doc_id: r.component_id for r in minhash.near_classes(docs).collect()}
    sets, links = near(texts)
    want = classes_of(texts, links)
    assert got == want
    least = lambda a, b: 100 * len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert seen and all(least(a, b) >= 75 for a, b in seen)


def test_blocks_hold_documents_by_their_open_keys_only(spark):
    # All have the same set and half keys; keys 8 and 9 belong to the second half key of the first collection, 0 and 63 to others.
    halves = [5, 7, *range(10, 16), 5, 7, *range(20, 26)]
    docs = spark.createDataFrame([(1, 1, 3, halves, 1 << 8), (2, 2, 3, halves, 3 << 8), (3, 3, 3, halves, -(2**63)), (4, 4, 3, halves, 1)], "doc_id long, label long, n_shingles long, half_keys array<long>, open long")
    sets = docs.select("doc_id", F.expr("transform(sequence(1L, 3L), x -> shiftleft(x, 40))").alias("shingles"))
    assert [(r.a, r.b) for r in minhash._links_in_blocks(docs, sets, 85).collect()] == [(1, 2)]

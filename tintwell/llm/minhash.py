"""MinHash near-dedup with tensored banding and links confirmed on full shingle sets."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintwell.llm.common import components, slices, written
from tintwell.llm.shingles import mixed, shingle_set, word_hashes

#: Words of a shingle and least similarity in percent.
WIDTH, PERCENT = 5, 85
#: Two collections of HALVES half keys, each of HASHES minhashes. Their pairs are the HALVES squared table keys, of
#: 2 * HASHES minhashes each, from 2 * HALVES * HASHES minhashes instead of HALVES squared times as many. A pair of
#: similarity s shares a key with probability (1 - (1 - s^HASHES)^HALVES)^2: 0.9990 at 0.85.
HALVES, HASHES = 8, 3
_rng = np.random.default_rng(8)
FACTORS = _rng.integers(1, 2**63, 2 * HALVES * HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _rng.integers(1, 2**63, 2 * HALVES * HASHES, dtype=np.uint64)
#: Pairs between classes that are compared at once when no more than this many for each row of the buckets are left.
PAIRS_PER_ROW = 4
#: Most documents and shingles on a side of a block, on average, and shingles of a matrix, that are compared at a time.
BLOCK, BLOCK_SHINGLES, COLUMNS = 1024, 1 << 19, 2048
#: Least cells of a shingle in a sketch.
CELLS = 4
#: Bits of a bitmap that every task gets, of 8 MB whatever the data; Spark builds bitmaps of 2 ** 15 bits, one a row.
BITS, ROW_BITS = 1 << 26, 1 << 15


def _half_keys(shingles: np.ndarray) -> np.ndarray:
    """HALVES keys of the first collection, then HALVES of the second."""
    if not len(shingles):
        return np.zeros(0, dtype=np.int64)
    low = np.full(len(FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096, None]
        low = np.minimum(low, mixed(part * FACTORS + OFFSETS).min(axis=0))
    keys = np.zeros(2 * HALVES, dtype=np.uint64)
    for k in range(HASHES):
        keys = mixed(keys * FACTORS[0] + low[k::HASHES])
    return keys.view(np.int64)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, set_key (128-bit digest of the shingle set, null where it is empty) and half_keys."""

    def run(batches):
        for batch in slices(batches):
            rows = []
            for doc_id, words in zip(batch["doc_id"], word_hashes(batch["text"])):
                s = shingle_set(words, width)
                rows.append((None if doc_id is None else int(doc_id), len(s), xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None, _half_keys(s)))
            out = pd.DataFrame(rows, columns=["doc_id", "n_shingles", "set_key", "half_keys"])
            yield out.astype({"doc_id": "Int64"})

    return _texts(docs, id_col, text_col).mapInPandas(run, "doc_id long, n_shingles long, set_key string, half_keys array<long>")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))


def _shingle_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """doc_id, n (its shingles), sketch and full shingle set of the documents in `ids`."""

    def run(batches):
        for batch in slices(batches):
            sets = [shingle_set(w, width) for w in word_hashes(batch["text"])]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("int64"), "n": list(map(len, sets)), "sketch": list(map(_sketch, sets)), "shingles": [s.view(np.int64) for s in sets]})

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    wanted = _perhaps_in(texts, ids, "doc_id").join(ids.select("doc_id"), "doc_id", "left_semi")
    # The join has dealt the rows by id, so one of each is kept without another shuffle.
    once = wanted.dropDuplicates(["doc_id"])
    return _texts(once, "doc_id", "text").mapInPandas(run, "doc_id long, n long, sketch binary, shingles array<long>")


def _sketch(shingles: np.ndarray) -> bytes:
    """A bitmap of a power of two of cells, CELLS to 2 * CELLS for a shingle, with those set that a shingle's lowest bits name."""
    cells = np.zeros(max(8, CELLS << (len(shingles) - 1).bit_length()), dtype=bool)
    cells[(shingles & np.uint64(len(cells) - 1)).astype(np.int64)] = True
    return np.packbits(cells).tobytes()


def _most_common(na: int, a: bytes, nb: int, b: bytes) -> int:
    """No fewer shingles than two sets of these sizes and sketches share: those in a cell that the other leaves empty are not shared."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    return min(na - int(np.bitwise_count(x & ~y).sum()), nb - int(np.bitwise_count(y & ~x).sum()))


def _perhaps_in(rows: DataFrame, wanted: DataFrame, col: str) -> DataFrame:
    """Rows whose `col` has a bit in the bitmap of those wanted: all that are wanted, and by chance a few others.

    It spares an exact semi join most of its shuffle as long as fewer values than BITS are wanted; beyond that it keeps
    more rows, and the join decides as before. Rows with a null in `col` go.
    """
    place = F.xxhash64(F.col(col).cast("long")).bitwiseAND(BITS - 1)
    part, at = F.shiftright(place, 15), place.bitwiseAND(ROW_BITS - 1)
    maps = wanted.where(F.col(col).isNotNull()).groupBy(part.alias("part")).agg(F.bitmap_construct_agg(at).alias("bits"))
    # As words of 64 bits, the first byte of a word on top.
    words = F.transform(F.sequence(F.lit(0), F.lit(ROW_BITS // 64 - 1)), lambda i: F.conv(F.hex(F.substring("bits", i * 8 + 1, F.lit(8))), 16, -10).cast("long"))
    maps = maps.select("part", words.alias("words"))
    bit = (7 - F.shiftright(at, 3).bitwiseAND(7)) * 8 + at.bitwiseAND(7)
    meets = F.getbit(F.col("maps.words")[F.shiftright(at, 6)], bit.cast("int")) == 1
    # A semi join, as Catalyst would put the exact one below an inner join.
    return rows.alias("rows").join(F.broadcast(maps).alias("maps"), (part == F.col("maps.part")) & meets, "left_semi")


def _likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches leave room for enough shared shingles: all that are similar enough, and few others."""

    def run(batches):
        for batch in slices(batches):
            common = np.fromiter(map(_most_common, batch["na"], batch["ka"], batch["nb"], batch["kb"]), np.int64, len(batch))
            yield batch.loc[100 * common >= percent * (batch["na"] + batch["nb"] - common), ["a", "b"]]

    left = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("ka"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("kb"))
    return pairs.join(left, "a").join(right, "b").mapInPandas(run, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. Only sets of documents in a pair are shuffled; `pairs` is read more than once."""
    ends = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))
    sets = _perhaps_in(sets.select("doc_id", "shingles"), ends, "doc_id")
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    both = both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("common"))
    return both.where(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def _table_keys(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, label, key and its number `at`: a row for each pair of a half key of the first collection and one of
    the second; where there is a column `open`, for those whose bit it has set."""
    first, second = F.slice("half_keys", 1, HALVES), F.slice("half_keys", HALVES + 1, HALVES)
    keys = F.flatten(F.transform(first, lambda a, i: F.transform(second, lambda b, j: F.xxhash64(a, b, i * HALVES + j))))
    rows = docs.where(F.size("half_keys") > 0)
    if "open" not in docs.columns:
        return rows.select("doc_id", "n_shingles", "label", F.posexplode(keys).alias("at", "key"))
    rows = rows.select("doc_id", "n_shingles", "label", "open", F.posexplode(keys).alias("at", "key"))
    return rows.where(F.getbit("open", F.col("at")) == 1).drop("open")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row per input row.

    Equal shingle sets are one class from the start. In each bucket of a table key the members are compared with one
    pivot, the same in most buckets of a group; confirmed links join classes, and the next round asks only between
    classes. Once few enough pairs of different classes share a bucket, all of them are compared one by one; where
    pivots no longer help, blocks of documents that share a half key are compared as matrices, which give one link for
    each two classes. So every pair that shares a table key is either compared or already connected, and the rows made
    grow with the buckets, not with their squares.

    Classes carry their labels on one row a document, with the keys that are still open as 64 bits; only the aggregates of
    a round see a row for each open key. Sets are shuffled only for pairs that their sketches do not rule out.

    Null and empty texts have no shingles and link with nothing; very long texts are compared whole. Pairs of exactly the
    least similarity link; a class is named by its smallest id, so ties do not matter. A null id is its own class; rows
    that repeat an id share its class, decided by one of them; an empty table gives no rows; other columns, whatever their
    names, are ignored.
    """
    rows = written(signatures(docs, id_col, text_col, width), "signatures")
    usable = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    # Written first, so that the join reads plain exchanges and a large group of copies can be split.
    copies = written(usable.groupBy("set_key").agg(F.min("doc_id").alias("first")), "firsts")
    copies = written(usable.select("doc_id", "set_key").join(copies, "set_key").select("doc_id", "first"), "copies")
    firsts = usable.join(copies.where("doc_id = first").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    firsts = written(firsts.select("doc_id", "n_shingles", "half_keys"), "one-each")
    edges = copies.where("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    sets = found = before = None
    docs_open = firsts.withColumn("label", F.col("doc_id"))
    while True:
        keys = _table_keys(docs_open)
        # At first every document is a class of its own.
        classes_of = keys.groupBy("key", "label").agg(F.count("*").alias("n")) if sets is not None else keys.select("key", F.lit(1).cast("long").alias("n"))
        counts = classes_of.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"))
        open_keys = written(counts.where("n * n > same"), "open")
        left, held = open_keys.agg(F.sum((F.col("n") * F.col("n") - F.col("same")) / 2), F.sum("n")).first()
        if not left:
            break
        now = written(_perhaps_in(keys, open_keys, "key").join(open_keys.select("key"), "key", "left_semi"), "members")
        # A key that is closed stays so, as classes only grow.
        open_docs = written(now.groupBy("doc_id").agg(F.expr("bit_or(shiftleft(1L, at))").alias("open")), "open-docs")
        if sets is None:
            sets = written(_shingle_sets(docs, open_docs, id_col, text_col, width), "sets")
            docs_open = _perhaps_in(docs_open, open_docs, "doc_id")
        docs_open = docs_open.drop("open").join(open_docs, "doc_id")
        few = left <= PAIRS_PER_ROW * held
        if not few and before and left > before / 2:
            blocks = written(_links_in_blocks(docs_open, _perhaps_in(sets, open_docs, "doc_id"), percent), "near")
            found = found.unionByName(written(_confirmed(blocks.distinct(), sets, percent), "links"))
            break
        pairs = _all_between(now) if few else _with_pivots(now)
        size = lambda x, y: F.least(x, y) * 100 >= percent * F.greatest(x, y)
        pairs = pairs.where(size(F.col("na"), F.col("nb"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        links = written(_confirmed(written(_likely(pairs, sets, percent), "likely"), sets, percent), "links")
        found = links if found is None else found.unionByName(links)
        if few:
            break
        before = left
        # Labels join one row a document; its keys follow from its half keys. Who has an open key has all those of its bucket beside it.
        labels = components(found).select(F.col("node").alias("doc_id"), F.col("component").alias("label"))
        still = docs_open.drop("label").join(labels, "doc_id", "left")
        docs_open = written(still.withColumn("label", F.coalesce("label", "doc_id")), "labelled")
    if found is not None:
        edges = edges.unionByName(found)
    classes = components(edges).select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))
    out = rows.select("doc_id", "n_shingles").join(classes, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _links_in_blocks(docs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between classes among documents that share a table key, compared in blocks of about BLOCK by BLOCK at most.

    Documents meet by the half keys of the first collection that an open key of theirs has; inside a block, those count
    that also share one of the second. They carry the upper halves of their shingle hashes; links are confirmed on full sets later. A block's output
    is the closest pair of each two classes, however many pairs are similar.
    """
    halves = F.posexplode(F.slice("half_keys", 1, HALVES)).alias("i", "half")
    of_open = F.expr(f"(shiftrightunsigned(open, {HALVES} * i) & {(1 << HALVES) - 1}) <> 0")
    upper = F.transform("shingles", lambda h: F.shiftright(h, 32).cast("int"))
    brief = docs.join(sets.select("doc_id", upper.alias("brief")), "doc_id").withColumnRenamed("n_shingles", "n")
    first = brief.select("doc_id", "label", "n", "brief", "open", F.slice("half_keys", HALVES + 1, HALVES).alias("second"), halves).where(of_open).drop("open")
    own = docs.select("label", F.col("n_shingles").alias("n"), "open", halves).where(of_open)
    sizes = own.groupBy("i", "half").agg(F.count("*").alias("docs"), F.sum("n").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    sizes = sizes.select("i", "half", F.ceil(F.greatest(F.col("docs") / BLOCK, F.col("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    rows = first.join(sizes, ["i", "half"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("other", "blocks")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = rows[rows["own"] == rows["lo"].iloc[0]], rows[rows["own"] == rows["hi"].iloc[0]]
        la, lb = left["label"].to_numpy(), right["label"].to_numpy()
        ha, hb = np.stack(left["second"].to_list()) if len(left) else np.zeros((0, HALVES)), np.stack(right["second"].to_list()) if len(right) else np.zeros((0, HALVES))
        meet = np.zeros((len(la), len(lb)), dtype=bool)
        for k in range(HALVES):
            meet |= ha[:, k, None] == hb[None, :, k]
        meet &= la[:, None] != lb[None, :]
        use_a, use_b = np.flatnonzero(meet.any(axis=1)), np.flatnonzero(meet.any(axis=0))
        none = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        if not len(use_a):
            return none
        sa = [np.unique(np.asarray(x, np.int32)) for x in left["brief"].iloc[use_a]]
        sb = [np.unique(np.asarray(x, np.int32)) for x in right["brief"].iloc[use_b]]
        na, nb = left["n"].to_numpy()[use_a], right["n"].to_numpy()[use_b]
        common = _common_counts(sa, sb)
        share = common / (na[:, None] + nb[None, :] - common)
        # Equal upper halves of different hashes may add a few, never take one away.
        near = meet[np.ix_(use_a, use_b)] & (100 * share >= percent - 1e-9)
        at, bt = np.nonzero(near)
        if not len(at):
            return none
        order = np.argsort(-share[at, bt], kind="stable")
        at, bt = use_a[at[order]], use_b[bt[order]]
        _, one = np.unique(np.stack([np.minimum(la[at], lb[bt]), np.maximum(la[at], lb[bt])]), axis=1, return_index=True)
        a, b = left["doc_id"].to_numpy()[at[one]], right["doc_id"].to_numpy()[bt[one]]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return rows.groupBy("i", "half", "lo", "hi").applyInPandas(compare, "a long, b long")


def _common_counts(sa: list[np.ndarray], sb: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of one list with all of the other, as products of 0/1 matrices."""
    shared = np.intersect1d(np.concatenate(sa), np.concatenate(sb))
    out = np.zeros((len(sa), len(sb)), dtype=np.float32)
    for at in range(0, len(shared), COLUMNS):
        part = shared[at : at + COLUMNS]
        out += _incidence(sa, part) @ _incidence(sb, part).T
    return out


def _incidence(sets: list[np.ndarray], ids: np.ndarray) -> np.ndarray:
    m = np.zeros((len(sets), len(ids)), dtype=np.float32)
    for row, s in zip(m, sets):
        s = s[np.searchsorted(s, ids[0]) : np.searchsorted(s, ids[-1], side="right")]
        at = np.searchsorted(ids, s)
        row[at[ids[at] == s]] = 1
    return m


def _with_pivots(now: DataFrame) -> DataFrame:
    """Members against the pivot of their bucket: the first by a hash of class and document, and so the same in most buckets of a group."""
    first = F.min(F.struct(F.xxhash64("label"), F.xxhash64("doc_id"), "doc_id", "n_shingles", "label")).alias("p")
    both = now.join(now.groupBy("key").agg(first), "key").where("label <> p.label")
    return both.select(F.col("doc_id").alias("a"), F.col("p.doc_id").alias("b"), F.col("n_shingles").alias("na"), F.col("p.n_shingles").alias("nb"))


def _all_between(now: DataFrame) -> DataFrame:
    a, b = now.alias("x"), now.alias("y")
    both = a.join(b, F.expr("x.key = y.key AND x.label < y.label"))
    return both.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"), F.col("x.n_shingles").alias("na"), F.col("y.n_shingles").alias("nb"))

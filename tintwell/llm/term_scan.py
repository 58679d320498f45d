"""Ranked lexical search without an index: one automaton of all item terms is run over the text of every document."""

from __future__ import annotations

import itertools
import math
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tintwell.llm.common import give_back, written

TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of UTF-8 as a term has them: A-Z in lower case, and a blank for each byte that no term has.
GUARDED = bytes(b if b > 0x7F or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
#: Results for each item; bytes of the terms of an automaton (a single item may have more, as its own text does), and items of it.
TOP, BLOCK_BYTES, BLOCK_ITEMS = 20, 1 << 20, 4096
#: Documents scored at a time, and entries of (document, item term, item) that are added up at a time.
ROWS, ENTRIES = 512, 1 << 21
#: First round of the global ranking.
SLOTS = 32
NO_ID = np.iinfo(np.int64).max

_counts = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])
COUNTS = "doc_id long, n long, terms array<int>, tfs array<int>"
_best = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
BEST = "item long, doc_id long, score long"


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item (a number for each row), item_id, term and how often the item has it."""
    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
    term = F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"({TERM})"), F.lit(1))).alias("term")
    return rows.select("item", "item_id", term).groupBy("item", "item_id", "term").agg(F.count("*").alias("times"))


class ItemTerms:
    """The distinct terms of a block of items in order, and for each term the items that have it, and how often."""

    def __init__(self, rows):
        self.items = sorted({r["item"] for r in rows})
        place = {item: i for i, item in enumerate(self.items)}
        rows = sorted((r["term"], place[r["item"]], r["times"]) for r in rows)
        self.terms = [t for t, _ in itertools.groupby(r[0] for r in rows)]
        number = {t: i for i, t in enumerate(self.terms)}
        self.item = np.array([r[1] for r in rows], dtype=np.int64)
        self.times = np.array([r[2] for r in rows], dtype=np.float64)
        self.starts = np.searchsorted([number[r[0]] for r in rows], np.arange(len(self.terms) + 1))

    def automaton(self):
        """An Aho-Corasick automaton of the terms between two blanks, so that no part of a longer term is found."""
        import ahocorasick

        out = ahocorasick.Automaton()
        for i, term in enumerate(self.terms):
            out.add_word(f" {term.encode().decode('latin-1')} ", i)
        out.make_automaton()
        return out


def term_counts(automaton, n_terms: int, text: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """Terms of a text, and the item terms it has, with their counts. Neighbours share the blank between them."""
    guarded = text.translate(GUARDED)
    n = len(guarded.split())
    if not n or not n_terms:
        return n, np.zeros(0, np.int32), np.zeros(0, np.int32)
    hits = map(itemgetter(1), automaton.iter(f" {guarded.decode('latin-1')} "))
    tfs = np.bincount(np.fromiter(hits, np.int32))
    terms = np.flatnonzero(tfs)
    return n, terms.astype(np.int32), tfs[terms].astype(np.int32)


def scan(docs: DataFrame, block: ItemTerms, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, and the numbers and counts of the block's terms, for each document that has any term at all."""
    shared = docs.sparkSession.sparkContext.broadcast(block.automaton())
    n_terms = len(block.terms)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = [(i, *term_counts(shared.value, n_terms, t.as_buffer().to_pybytes())) for i, t in enumerate(part.column(1)) if t.is_valid]
                found = [f for f in found if f[1]]
                ids = part.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                yield pa.record_batch([ids, pa.array([f[1] for f in found], pa.int64()), _lists([f[2] for f in found]), _lists([f[3] for f in found])], schema=_counts)
            del batch
            give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, COUNTS)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int32), pa.int32()))


class Top:
    """The `k` best documents of each item so far: highest score, then smallest id, a null id last."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.least = np.ones(n_items, dtype=np.int64)
        self.item, self.doc, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, ids: np.ndarray, scores: np.ndarray):
        """scores: a row for each document, a column for each item."""
        at, item = np.nonzero(scores >= self.least)
        if not len(at):
            return
        item, doc, score = np.concatenate([self.item, item]), np.concatenate([self.doc, ids[at]]), np.concatenate([self.score, scores[at, item]])
        order = np.lexsort((doc, -score, item))
        rank = np.arange(len(order)) - np.searchsorted(item[order], item[order])
        order = order[rank < self.k]
        self.item, self.doc, self.score = item[order], doc[order], score[order]
        full = np.flatnonzero(np.bincount(self.item, minlength=len(self.least)) == self.k)
        self.least[full] = self.score[np.searchsorted(self.item, full, side="right") - 1]


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)


def best_of(counts: DataFrame, block: ItemTerms, weight: np.ndarray, documents: int, terms: int, k: int = TOP) -> DataFrame:
    """item, doc_id and score of every task's `k` best documents for each item of the block."""
    shared = counts.sparkSession.sparkContext.broadcast((block.item, block.times, block.starts, weight, np.array(block.items, dtype=np.int64)))

    def run(batches):
        item, times, starts, weight, names = shared.value
        top = Top(len(names), k)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = part.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
                m = 75 + 25 * part.column("n").to_numpy(zero_copy_only=False) * documents // terms
                sizes = part.column("terms").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                term, tf = (part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("terms", "tfs"))
                doc = np.repeat(np.arange(len(ids)), sizes)
                gain = weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
                spread = starts[term + 1] - starts[term]
                scores = np.zeros(len(ids) * len(names))
                # Sums stay far below 2^53, where doubles are whole numbers.
                for a, b in _cuts(spread):
                    width = spread[a:b]
                    entry = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width - starts[term[a:b]], width)
                    cell = np.repeat(doc[a:b] * len(names), width) + item[entry]
                    scores += np.bincount(cell, np.repeat(gain[a:b], width) * times[entry], minlength=len(scores))
                top.add(ids, scores.astype(np.int64).reshape(len(ids), -1))
        yield pa.record_batch([pa.array(names[top.item]), pa.array(top.doc, mask=top.doc == NO_ID), pa.array(top.score)], schema=_best)

    return counts.mapInArrow(run, BEST)


def _cuts(sizes: np.ndarray):
    """Consecutive ranges of about ENTRIES in all, of one term at least."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        done = ends[at - 1] if at else 0
        b = max(at + 1, int(np.searchsorted(ends, done + ENTRIES, side="right")))
        yield at, b
        at = b


def _blocks(terms: DataFrame) -> list[DataFrame]:
    """The items in blocks of BLOCK_ITEMS at most whose terms take BLOCK_BYTES at most, but for a block of a single item."""
    size = F.sum(F.octet_length("term") + 24).alias("bytes")
    items = F.count_distinct("item").alias("items")
    total = terms.agg(size).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    while True:
        part = F.pmod(F.xxhash64("item"), F.lit(n))
        parts = terms.groupBy(part.alias("part")).agg(size, items)
        large = parts.where((F.col("bytes") > BLOCK_BYTES) & (F.col("items") > 1) | (F.col("items") > BLOCK_ITEMS))
        if large.isEmpty():
            return [terms.where(part == r["part"]) for r in parts.collect()]
        n *= 2


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of the `k` documents that match each item best, of those with a score above 0.

    The terms of a block of items, of a bounded number of bytes, are broadcast as one automaton and counted in every text,
    which gives rows of (term number, count) in place of an index; they are written once and read twice, for the documents
    that hold each term and for the scores. A task keeps `k` documents an item; they are ranked in two rounds, by item and
    a hash of the document, then by item.

    Terms are the longest stretches of letters and digits of ASCII and of all other characters beyond it, only A-Z in lower
    case. Null texts and texts without a term are no documents here, and match nothing; an item without a term gives no
    rows; very long texts are scanned whole. Equal scores go by document id, a null id last. Documents that repeat an id
    count and rank each; items that repeat an id are ranked each. Either table may be empty; other columns, whatever their
    names, are ignored.
    """
    spark: SparkSession = docs.sparkSession
    terms = written(item_terms(items, item_id_col, item_text_col), "item-terms")
    parts, totals = [], None
    for rows in _blocks(terms):
        block = ItemTerms([r.asDict() for r in rows.select("item", "term", "times").collect()])
        counts = written(scan(docs, block, id_col, text_col), "term-counts")
        if totals is None:
            totals = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not totals[0] or not block.terms:
            continue
        held = dict(counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
        weight = weights(np.array([held.get(i, 0) for i in range(len(block.terms))]), totals[0])
        parts.append(best_of(counts, block, weight, *totals, k))
    best = spark.createDataFrame([], BEST)
    for part in parts:
        best = best.unionByName(part)
    for keys in (["item", "slot"], ["item"]):
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = best.withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS))).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(terms.select("item", "item_id").distinct(), "item").select("item_id", "rank", "doc_id", "score")

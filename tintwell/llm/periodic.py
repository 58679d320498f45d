"""Runs of words that repeat with a period, found by recursive frequency splitting and a lag scan."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tintwell.llm.common import WORD, slices
from tintwell.llm.shingles import mixed

#: A run has at least so many words and so many periods.
LEAST, TIMES = 24, 3
#: Pairs of neighbouring blocks that are compared at a time.
PAIRS = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)

SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class Numbers(dict):
    """Numbers words in the order they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        return at


def stable_segments(words: np.ndarray, doc: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """(start, end) of the stretches that may hold runs; `words` holds the numbered words of many documents in a row.

    A run has each of its words at least `times` times. So a word that its segment has less often is in no run there and
    splits the segment; the parts are split again, by their own counts, until none changes. Parts shorter than `least` go.
    """
    out = []
    at, seg = np.arange(len(words)), doc.astype(np.int64)
    size = np.int64(words.max() + 1) if len(words) else np.int64(1)
    while len(at):
        _, back, counts = np.unique(seg * size + words[at], return_inverse=True, return_counts=True)
        stays = counts[back] >= times
        first = np.flatnonzero(np.diff(seg, prepend=-1))
        whole = np.logical_and.reduceat(stays, first)
        ends = np.append(first[1:], len(at))
        out += [(int(at[a]), int(at[b - 1]) + 1) for a, b in zip(first[whole], ends[whole]) if b - a >= least]
        # What did not change is done; the rest goes on in parts.
        stays &= ~np.repeat(whole, ends - first)
        at, seg = at[stays], seg[stays]
        if not len(at):
            break
        new = np.cumsum((np.diff(at, prepend=at[0]) != 1) | (np.diff(seg, prepend=seg[0]) != 0))
        long = np.bincount(new)[new] >= least
        at, seg = at[long], new[long]
    return sorted(out)


class Found:
    """Runs of a segment so far, asked whether one of a period that divides another covers a stretch."""

    def __init__(self):
        self.runs: list[tuple[int, int, int]] = []

    def add(self, starts, ends, period: int):
        self.runs += [(int(a), int(b), period) for a, b in zip(starts, ends)]

    def cover(self, starts: np.ndarray, ends: np.ndarray, period: int) -> np.ndarray:
        own = sorted((a, b) for a, b, q in self.runs if period % q == 0)
        if not own:
            return np.zeros(len(starts), dtype=bool)
        lows, highs = np.array(own).T
        # Among the runs that begin no later, is there one that ends no earlier?
        reach = np.concatenate([[-1], np.maximum.accumulate(highs)])
        return reach[np.searchsorted(lows, starts, side="right")] >= ends


def _repeated_blocks(words: np.ndarray, times: int):
    """(period, starts) of the lags at which neighbouring blocks look equal.

    A run of three periods or more holds two whole neighbouring blocks that start at multiples of its period. So lag q
    needs only n / q comparisons of block hashes, n log n over all lags. Equal blocks always have equal hashes.
    """
    n = len(words)
    powers = np.full(n + 1, BASE, dtype=np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(words.astype(np.uint64) + np.uint64(1)) * powers[:n], dtype=np.uint64)])
    q = 1
    while q <= n // times:
        # As many lags as make about PAIRS comparisons; the first of them has the most.
        lags = np.arange(q, min(n // times, q + max(1, PAIRS * q // n)) + 1)
        counts = n // lags - 1
        lag = np.repeat(lags, counts)
        start = (np.arange(len(lag)) - np.repeat(np.cumsum(counts) - counts, counts)) * lag
        middle = sums[start + lag]
        equal = np.flatnonzero((middle - sums[start]) * powers[lag] == sums[start + 2 * lag] - middle)
        for part in np.split(equal, np.flatnonzero(np.diff(lag[equal])) + 1):
            if len(part):
                yield int(lag[part[0]]), start[part]
        q = int(lags[-1]) + 1


def lag_scan(words: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period.

    Lags are taken in rising order. Blocks inside a run of a period that divides the lag are that run again. For what is
    left, the words themselves are compared at this lag, so a run's ends do not rest on hashes.
    """
    if times < 3:
        raise ValueError("runs of fewer than three periods need not hold two aligned blocks")
    found, n = Found(), len(words)
    for q, starts in _repeated_blocks(words, times):
        if found.cover(starts, starts + 2 * q, q).all():
            continue
        breaks = np.concatenate([[-1], np.flatnonzero(words[:-q] != words[q:]), [n - q]])
        lows, highs = breaks[:-1] + 1, breaks[1:] + q
        fits = highs - lows >= max(least, times * q)
        lows, highs = lows[fits], highs[fits]
        new = ~found.cover(lows, highs, q)
        found.add(lows[new], highs[new], q)
    return sorted((a, b - a, q) for a, b, q in found.runs)


def runs_of(texts: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """Runs of each of several texts, given as lists of words."""
    numbers = Numbers()
    words = np.fromiter((numbers[w] for t in texts for w in t), np.int64)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    out = [[] for _ in texts]
    for a, b in stable_segments(words, np.repeat(np.arange(len(texts)), sizes), least, times):
        doc = int(np.searchsorted(ends, a, side="right"))
        base = a - int(ends[doc] - sizes[doc])
        out[doc] += [(base + s, n, q) for s, n, q in lag_scan(words[a:b], least, times)]
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words), dtype=bool)
    for s, n, q in runs:
        gone[s + q : s + n] = True
    return b" ".join(words[i] for i in np.flatnonzero(~gone))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs (start, length and smallest period, by start, then period) and collapsed, one row per input row.

    Words are cut at the six ASCII blanks and numbered from 0. A run is a stretch whose words a period apart are identical,
    of at least `least` words and `times` periods, and as long as it can be; runs may overlap. `collapsed` keeps the first
    period of each run and every word outside of them. Every document is a row of one task and nothing is shuffled, so a
    frequent text or source is no hot spot; a task holds a few hundred documents at a time.

    Null and empty texts, and those of blanks alone, have no words, no runs and an empty `collapsed`. A very long text is
    scanned whole, in memory that grows with its words. Ties do not arise, as all runs are given; rows that repeat are each
    answered; a null id is kept; an empty table gives no rows; other columns, whatever their names, are ignored.
    """

    def run(batches):
        for batch in slices(batches):
            texts = [t.split() for t in batch["text"]]
            runs = runs_of(texts, least, times)
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].astype("Int64"),
                    "n_words": [len(t) for t in texts],
                    "runs": [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs],
                    "collapsed": [collapsed(t, r).decode() for t, r in zip(texts, runs)],
                }
            )

    # Ids travel as text, as pandas has no whole numbers with nulls.
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return rows.mapInPandas(run, SCHEMA)


def with_planted_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text, where every tenth document by the CRC-32 of its decimal id repeats a stretch of its words to its end.

    With h that number and g = floor(h / 10), word i of n, from a = g % n on, becomes word a + (i - a) % p, where
    p = 1 + floor((n - a) / (3 + g % 8)). Null texts become empty; a null id is not among the tenth.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.floor(h / 10).alias("g"), F.coalesce(h % 10 == 0, F.lit(False)).alias("planted"))
    rows = rows.withColumn("words", F.when(F.col("planted"), F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))))
    n = F.size("words")
    a = F.expr("g % size(words)")
    rows = rows.withColumn("a", F.when(n > 0, a).cast("int"))
    rows = rows.withColumn("p", F.expr("cast(1 + floor((size(words) - a) / (3 + g % 8)) as int)"))
    # The block is laid out as often as the rest of the text needs it, and the end cut off.
    tail = F.expr("slice(flatten(array_repeat(slice(words, a + 1, p), cast(ceil((size(words) - a) / p) as int))), 1, size(words) - a)")
    made = F.array_join(F.concat(F.expr("slice(words, 1, a)"), tail), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), made).otherwise(F.col("text")).alias("text"))


def run_digests(rows: DataFrame) -> DataFrame:
    """n_runs, the run of greatest exact length / period (ties: smallest start, then period) and digests of what `periodic_runs` found."""
    # Runs come by start, then period, so a later one must be truly greater.
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda x, y: F.when(y["length"] * x["period"] > x["length"] * y["period"], y).otherwise(x))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    rows = rows.withColumn("best", best)
    sha: Column = F.sha2(F.array_join(line, "").cast("binary"), 256)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        sha.alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )

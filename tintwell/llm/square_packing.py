"""Best-fit packing by the sum of squares of open sequences per gap."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintwell.llm.common import slices, written
from tintwell.llm.packing import WordIds

LENGTH = 4096
#: Id that ends a document.
END_ID = 1
#: About how many ids and pieces a group that is packed together has.
GROUP_IDS, GROUP_PIECES = 1 << 24, 1 << 16
#: Rows of a task take their numbers from a range of their own.
PER_TASK = 1 << 33

PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"
PLACES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class Squares:
    """Open sequences by gap. A piece goes where the sum over all gaps of (open sequences of that gap) squared gets least.

    A piece of size s turns a sequence of gap g into one of gap g - s: the sum changes by 1 - 2 N(g), and by 2 N(g - s) + 1
    more unless the sequence is full then. A new sequence changes it by 2 N(length - s) + 1. Equal changes: the smallest gap.
    """

    def __init__(self, length: int = LENGTH):
        self.length = length
        self.open = np.zeros(length, dtype=np.int64)
        self.of_gap: dict[int, list[list[tuple[int, int]]]] = defaultdict(list)
        self.full: list[list[tuple[int, int]]] = []

    def _best(self, size: int, new: bool) -> int | None:
        """The gap to fill, `length` for a new sequence; None where nothing fits and none may be opened."""
        gaps = self.open[size:]
        change = 2 * (self.open[: self.length - size] - gaps) + 2
        change[:1] = 1 - 2 * gaps[:1]
        at = np.flatnonzero(gaps)
        if len(at):
            k = at[change[at].argmin()]
            if not new or change[k] <= 2 * self.open[self.length - size] + 1:
                return size + int(k)
        return self.length if new else None

    def put(self, item: int, size: int, new: bool = True) -> bool:
        """Places an item; False where it fits nowhere and no sequence may be opened."""
        if size == self.length:
            self.full.append([(item, size)])
            return True
        gap = self._best(size, new)
        if gap is None:
            return False
        pieces = []
        if gap < self.length:
            pieces = self.of_gap[gap].pop()
            self.open[gap] -= 1
        pieces.append((item, size))
        self._keep(pieces, gap - size)
        return True

    def _keep(self, pieces, gap: int):
        if gap:
            self.of_gap[gap].append(pieces)
            self.open[gap] += 1
        else:
            self.full.append(pieces)

    def dissolve(self):
        """Deals the pieces of the emptiest sequence to the gaps of the others, by the same rule, while all of them fit."""
        while self.open.any():
            gap = int(np.flatnonzero(self.open)[-1])
            pieces = self.of_gap[gap].pop()
            self.open[gap] -= 1
            counts = self.open.copy()
            sizes = sorted((n for _, n in pieces), reverse=True)
            for n in sizes:
                to = self._best(n, False)
                if to is None:
                    break
                self.open[to] -= 1
                if to > n:
                    self.open[to - n] += 1
            else:
                self.open = counts
                for item, n in sorted(pieces, key=lambda p: -p[1]):
                    self.put(item, n, False)
                continue
            self.open = counts
            self._keep(pieces, gap)
            return

    def sequences(self) -> list[list[tuple[int, int]]]:
        return self.full + [p for gap in sorted(self.of_gap) for p in self.of_gap[gap]]


def packed(sizes: np.ndarray, length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Sequences of (item, size), long items first."""
    squares = Squares(length)
    for item in np.argsort(-sizes, kind="stable"):
        squares.put(int(item), int(sizes[item]))
    squares.dissolve()
    return squares.sequences()


def cut_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """row, doc_id, piece, start, length and ids_crc32 of each document's ids in pieces of `length`; the last may be shorter."""

    def run(batches):
        words = WordIds.of(tokenizer_path)
        number = TaskContext.get().partitionId() * PER_TASK
        for part in slices(batches):
            rows = []
            for doc_id, ids in zip(part["doc_id"], words.encode(list(part["text"]))):
                data = np.append(ids, np.uint32(end_id)).astype("<u4", copy=False)
                for k, at in enumerate(range(0, len(data), length)):
                    piece = data[at : at + length]
                    rows.append((number, None if doc_id is None else int(doc_id), k, at, len(piece), zlib.crc32(piece)))
                    number += 1
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")]).astype({"doc_id": "Int64"})

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(run, PIECES)


def square_pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece; only documents over `length` are cut.

    Texts are encoded where they are read, and the pieces, a few numbers each, are written. Pieces of full length are
    sequences by themselves. All others are dealt by their row number, not by a key, into as many groups as their ids and
    their number ask for, so groups stay of one size however large the table or however frequent an id. A group is
    packed by one task, long pieces first; what it leaves open at its end is less than a part in a thousand of a full group.

    Null and empty texts have the end id alone. Very long texts are cut into many pieces. Equal sizes go by row number;
    repeated rows are packed each; a null id is kept; an empty table gives no rows; other columns, whatever their names,
    are ignored.
    """
    rows = written(cut_documents(docs, tokenizer_path, id_col, text_col, length, end_id), "pieces")
    whole = F.col("length") == length
    ids, pieces = rows.where(~whole).agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    groups = max(1, -(-ids // GROUP_IDS), -(-pieces // GROUP_PIECES))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("row", ignore_index=True)
        base = int(part["group"].iloc[0]) * PER_TASK
        item, sequence, offset = [], [], []
        for k, pieces in enumerate(packed(part["length"].to_numpy(), length)):
            at = 0
            for i, n in pieces:
                item.append(i)
                sequence.append(2 * (base + k) + 1)
                offset.append(at)
                at += n
        out = part.iloc[item].reset_index(drop=True)
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out.assign(sequence_id=sequence, offset=offset)[[c.split()[0] for c in PLACES.split(", ")]]

    columns = [F.col(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
    # Rows of one group are even; those packed have odd numbers.
    alone = rows.where(whole).select(*columns, (2 * F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    group = F.pmod(F.xxhash64("row"), F.lit(groups)).alias("group")
    rest = rows.where(~whole).select("row", F.col("doc_id").cast("string").alias("doc_id"), *columns[1:], group)
    return alone.unionByName(rest.groupBy("group").applyInPandas(run, PLACES))

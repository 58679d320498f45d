"""Hierarchical packing of documents into context windows of several lengths."""

from __future__ import annotations

import bisect
import heapq
import itertools
import unicodedata
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintwell.llm.common import slices

TIERS = (512, 1024, 2048, 4096)
#: Id that ends a document.
END_ID = 2
#: Ids held by a task before it packs them, and words whose ids a task remembers.
WINDOW_IDS, WORDS_KEPT = 1_000_000, 400_000
#: Marks that a word may end in, and words encoded in a run.
MARKS, RUN = ".,;:!?", 2048
#: Full-length windows' worth of ids in a step.
STEP_WINDOWS = 8
#: Sequences of a task take their numbers from a range of their own.
PER_TASK = 1 << 33

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_id long"


def _word_ends(word: str) -> int:
    """Word ends that the ids of a plain word have: 1 for letters, 2 with a mark after them; 0 for any other word.

    Lower case and composed form, which the tokenizer applies first, can turn a letter into several characters.
    """
    if not word.isascii():
        if not unicodedata.is_normalized("NFC", word):
            return 0
        word = word.lower()
    return 1 if word.isalpha() else 2 if word[-1] in MARKS and word[:-1].isalpha() else 0


class Places(dict):
    """Numbers words in the order they are met; `new` holds those not yet encoded."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at


class WordIds:
    """Ids of texts by a word-level tokenizer file.

    The tokenizer drops blanks and never joins words over one, so the ids of a text are the ids of its words; each
    distinct word is encoded once while it is remembered.
    """

    _open: dict[str, WordIds] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends_word[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self._clear()

    def _clear(self):
        self.place = Places()
        self.lengths = np.zeros(0, dtype=np.int32)
        self.starts = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.uint32)

    @classmethod
    def of(cls, path: str) -> WordIds:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _learn(self):
        """Encodes the new words. Words of letters alone, or with one mark at the end, give one or two word ends and go in runs."""
        new, self.place.new = [w.decode() for w in self.place.new], []
        if not new:
            return
        ends = np.fromiter(map(_word_ends, new), np.int8, len(new))
        plain, odd = np.flatnonzero(ends), np.flatnonzero(ends == 0)
        runs = [plain[a : a + RUN] for a in range(0, len(plain), RUN)]
        encode = self.tokenizer.encode_batch_fast
        ids = [np.array(e.ids, dtype=np.uint32) for e in encode([" ".join([new[i] for i in run]) for run in runs] + [new[i] for i in odd], add_special_tokens=False)]
        last = [np.flatnonzero(self.ends_word[x])[np.cumsum(ends[run], dtype=np.int64) - 1] + 1 for run, x in zip(runs, ids)]
        lengths = np.zeros(len(new), dtype=np.int32)
        lengths[plain] = np.concatenate([np.diff(x, prepend=0) for x in last]) if runs else 0
        lengths[odd] = [len(x) for x in ids[len(runs) :]]
        order = np.concatenate([plain, odd])
        starts = np.zeros(len(new), dtype=np.int64)
        starts[order] = len(self.flat) + np.cumsum(lengths[order], dtype=np.int64) - lengths[order]
        self.flat = np.concatenate([self.flat, *ids])
        self.starts, self.lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, all words of the texts at once."""
        if len(self.place) > WORDS_KEPT:
            self._clear()
        # The tokenizer lowers letters itself; done before, fewer words differ. Only its special strings are as written.
        split = [(t.encode() if "<|" in t else t.encode().lower()).split() for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter(map(self.place.__getitem__, itertools.chain.from_iterable(split)), np.int64, sizes.sum())
        self._learn()
        counts = self.lengths[at]
        ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        ids = self.flat[np.arange(ends[-1]) - np.repeat(ends[:-1] - self.starts[at], counts)]
        cuts = ends[np.concatenate([[0], np.cumsum(sizes)])]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


class Packer:
    """Pieces waiting per tier, and the sequences made of them. A piece is (length, order, document, start)."""

    def __init__(self, tiers=TIERS):
        self.tiers = tuple(sorted(tiers))
        self.waiting = {t: [] for t in self.tiers}
        self.full: list[tuple[int, list]] = []
        self.order = 0

    def tier_of(self, n: int) -> int:
        return self.tiers[bisect.bisect_left(self.tiers, n)]

    def put(self, doc: int, start: int, length: int):
        self.order += 1
        bisect.insort(self.waiting[self.tier_of(length)], (length, self.order, doc, start))

    def add(self, doc: int, n: int):
        """Whole windows of the longest tier become sequences at once; the rest waits in the tier it fits."""
        longest = self.tiers[-1]
        for start in range(0, n - longest + 1, longest):
            self.full.append((longest, [(longest, 0, doc, start)]))
        if n % longest:
            self.put(doc, n - n % longest, n % longest)

    def _largest(self, gap: int):
        """The longest waiting piece of at most `gap` ids."""
        for tier in reversed(self.tiers[: bisect.bisect_left(self.tiers, gap) + 1]):
            pool = self.waiting[tier]
            at = bisect.bisect_left(pool, (gap + 1,))
            if at:
                return pool.pop(at - 1)
        return None

    def _any(self, tier: int):
        """A piece to cut: the longest of the shortest tier that has one, up to `tier`."""
        for t in self.tiers:
            if t > tier:
                return None
            if self.waiting[t]:
                return self.waiting[t].pop()
        return None

    def pack(self, last: bool):
        """Fills windows from the longest tier down; gaps take shorter pieces whole, then the head of one that is cut."""
        for tier in reversed(self.tiers):
            while self.waiting[tier]:
                pieces, gap = [self.waiting[tier].pop()], tier
                gap -= pieces[0][0]
                while gap and (p := self._largest(gap)):
                    pieces.append(p)
                    gap -= p[0]
                if gap and (p := self._any(tier)):
                    pieces.append((gap, p[1], p[2], p[3]))
                    self.put(p[2], p[3] + gap, p[0] - gap)
                    gap = 0
                if not gap:
                    self.full.append((tier, pieces))
                    continue
                # Nothing is left that could fill it.
                if last:
                    self._tail(tier, pieces)
                else:
                    for n, _, doc, start in pieces:
                        self.put(doc, start, n)
                return

    def _tail(self, tier: int, pieces: list):
        """The last ids of a task: windows of powers of two down to 64, which need no padding, then one that is padded."""
        width = tier
        while pieces:
            left = sum(p[0] for p in pieces)
            while width > 64 and width > left:
                width //= 2
            window, gap = [], min(width, left)
            while gap:
                n, o, doc, start = pieces.pop(0)
                window.append((min(n, gap), o, doc, start))
                if n > gap:
                    pieces.insert(0, (n - gap, o, doc, start + gap))
                gap -= min(n, gap)
            self.full.append((width, window))

    def steps(self, windows: int) -> list[int]:
        """A step for each full sequence: longest first, each to the step with the fewest ids so far."""
        total = sum(n for n, _ in self.full)
        loads = [0] * max(1, -(-total // (windows * self.tiers[-1])))
        out = [0] * len(self.full)
        heap = [(0, i) for i in range(len(loads))]
        for at in sorted(range(len(self.full)), key=lambda i: -self.full[i][0]):
            load, step = heapq.heappop(heap)
            out[at] = step
            heapq.heappush(heap, (load + self.full[at][0], step))
        return out


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", tiers=TIERS, end_id: int = END_ID) -> DataFrame:
    """Pieces of documents in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_id.

    Documents go to the shortest tier that holds what is left of them after whole windows of the longest. Each task packs
    its own rows in windows of a bounded number of ids, so nothing is shuffled; what does not fill a sequence is carried
    on, and only the last ids of a task are padded. Steps have about the same number of ids each.

    Null and empty texts have the end id alone. Very long texts fill whole windows of the longest tier. Pieces of equal
    length go by their order in the task. Repeated rows are packed each, a null id is kept, an empty table gives no rows,
    and other columns, whatever their names, are ignored.
    """

    def run(batches):
        words, packer = WordIds.of(tokenizer_path), Packer(tiers)
        base = TaskContext.get().partitionId() * PER_TASK
        made = steps_made = 0
        ids: dict[int, np.ndarray] = {}
        names: dict[int, object] = {}
        held = number = 0

        def flush(last: bool):
            nonlocal made, steps_made, held
            packer.pack(last)
            rows, steps = [], packer.steps(STEP_WINDOWS)
            for (tier, pieces), step in zip(packer.full, steps):
                offset = 0
                for n, _, doc, start in pieces:
                    part = ids[doc][start : start + n]
                    rows.append((names[doc], start, n, zlib.crc32(part.astype("<u4").tobytes()), len(ids[doc]), base + made, offset, tier, base + steps_made + step))
                    offset += n
                made += 1
            steps_made += max(steps, default=-1) + 1
            packer.full = []
            open_docs = {p[2] for pool in packer.waiting.values() for p in pool}
            for doc in [d for d in ids if d not in open_docs]:
                del ids[doc], names[doc]
            held = 0
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            out["doc_id"] = out["doc_id"].astype("Int64")
            return out

        for part in slices(batches):
            for doc_id, x in zip(part["doc_id"], words.encode(list(part["text"]))):
                ids[number] = np.append(x, np.uint32(end_id))
                names[number] = None if doc_id is None else int(doc_id)
                packer.add(number, len(ids[number]))
                held += len(ids[number])
                number += 1
            if held >= WINDOW_IDS:
                yield flush(False)
        yield flush(True)

    # Ids travel as text, as pandas has no whole numbers with nulls.
    return docs.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(run, SCHEMA)

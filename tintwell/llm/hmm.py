"""Hidden Markov language model: Baum-Welch over the whole corpus, exact sequence likelihoods by scaled forward recursion."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tintwell.llm.common import written

#: Latent states, rounds of Baum-Welch, and the seed of the first emissions.
STATES, ROUNDS, SEED = 6, 4, 9
#: Words whose counts every task knows; of these, words with a class of their own; classes that the other words share.
KNOWN, OWN, SHARED = 262_144, 8192, 4096
END = OWN + SHARED
CLASSES = END + 1
#: Prior weight of the overall class shares in a state's emissions, in tokens, and of each transition.
PRIOR, MOVES = 200.0, 1.0
#: Tokens of a chunk, about how many tokens are handled together, and words a task remembers.
CHUNK, TOGETHER, WORDS_KEPT = 256, 1 << 18, 1_000_000


class Words(dict):
    """Numbers words in the order they are met and keeps their 64-bit hashes."""

    def __init__(self):
        self.hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return at

    def numbered(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words of the texts in turn, A-Z in lower case, and the words of each text."""
        split = [t.lower().split() for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        return np.fromiter(map(self.__getitem__, itertools.chain.from_iterable(split)), np.int64, sizes.sum()), sizes

    def as_long(self, start: int = 0) -> np.ndarray:
        return np.array(self.hashes[start:], dtype=np.uint64).view(np.int64)


def held_out(doc_id: Column, parts: int = 7, part: int = 2) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")
    return docs.select(F.col(id_col).cast("string").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), text)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n): 64-bit word hash and count over the training texts. Tasks count before the shuffle."""

    def run(batches):
        words, counts = Words(), np.zeros(0, dtype=np.int64)
        for batch in batches:
            for at in range(0, len(batch), 1024):
                numbers, _ = words.numbered(list(batch["text"].iloc[at : at + 1024]))
                counts = np.concatenate([counts, np.zeros(len(words) - len(counts), dtype=np.int64)])
                counts += np.bincount(numbers, minlength=len(counts))
                if len(words) > WORDS_KEPT:
                    yield pd.DataFrame({"word": words.as_long(), "n": counts})
                    words, counts = Words(), np.zeros(0, dtype=np.int64)
        yield pd.DataFrame({"word": words.as_long(), "n": counts})

    return texts.where("NOT held_out").select("text").mapInPandas(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The frequent words, sorted by hash, with their counts and classes; and the weight of every class."""

    words: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    weights: np.ndarray
    tokens: int
    distinct: int

    @property
    def total(self) -> float:
        """All counts with one added, and one unknown word in each shared class."""
        return float(self.tokens + self.distinct + SHARED)


def vocabulary(counts: DataFrame, training_docs: int) -> Vocabulary:
    """Takes at most KNOWN words to the driver: those from a count up that a histogram of 1/16 octaves finds low enough."""
    step = F.floor(F.log2("n") * 16).cast("int")
    bins = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).toPandas().sort_values("step", ascending=False)
    fits = bins[bins["words"].cumsum() <= KNOWN]
    least = int(fits["step"].min()) if len(fits) else 1 << 30
    top = counts.where(step >= least).toPandas().sort_values(["n", "word"], ascending=[False, True]).reset_index(drop=True)
    words, n = top["word"].to_numpy(np.int64), top["n"].to_numpy(np.int64)
    classes = np.where(np.arange(len(words)) < OWN, np.arange(len(words)), OWN + np.mod(words, SHARED))
    shared = counts.groupBy(F.pmod("word", F.lit(SHARED)).cast("int").alias("at")).agg(F.sum(F.col("n") + 1).alias("w")).toPandas()
    weights = np.zeros(CLASSES)
    weights[OWN + shared["at"].to_numpy(np.int64)] = shared["w"].to_numpy(np.float64)
    np.add.at(weights, OWN + np.mod(words[:OWN], SHARED), -(n[:OWN] + 1.0))
    weights[OWN:END] += 1
    weights[: min(OWN, len(words))] = n[:OWN] + 1.0
    weights[END] = training_docs + 1
    order = np.argsort(words)
    tokens, distinct = int(bins["tokens"].sum()) + training_docs, int(bins["words"].sum()) + (training_docs > 0)
    return Vocabulary(words[order], n[order], classes[order].astype(np.uint16), weights, tokens, distinct)


def coded(texts: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Per text: n_tokens, the known frequent words and the sum of log10(count + 1) over them, classes of all tokens, other words."""

    def run(batches):
        words = Words()
        cls, logs, rare = np.zeros(0, np.uint16), np.zeros(0), np.zeros(0, bool)
        for batch in batches:
            for at in range(0, len(batch), 1024):
                if len(words) > WORDS_KEPT:
                    words = Words()
                    cls, logs, rare = np.zeros(0, np.uint16), np.zeros(0), np.zeros(0, bool)
                part = batch.iloc[at : at + 1024]
                numbers, sizes = words.numbered(list(part["text"]))
                new = words.as_long(len(cls))
                place = np.minimum(np.searchsorted(vocab.words, new), max(0, len(vocab.words) - 1))
                hit = vocab.words[place] == new if len(vocab.words) else np.zeros(len(new), bool)
                own = (OWN + np.mod(new, SHARED)).astype(np.uint16)
                if len(vocab.words):
                    own = np.where(hit, vocab.classes[place], own)
                    logs = np.concatenate([logs, np.where(hit, np.log10(vocab.counts[place] + 1.0), 0.0)])
                else:
                    logs = np.concatenate([logs, np.zeros(len(new))])
                cls, rare = np.concatenate([cls, own]), np.concatenate([rare, ~hit])
                hashes = words.as_long()
                ends = np.concatenate([[0], np.cumsum(sizes)])
                rows = []
                for doc, out, a, b in zip(part["doc_id"], part["held_out"], ends[:-1], ends[1:]):
                    own = numbers[a:b]
                    odd = rare[own]
                    classes = np.append(cls[own], np.uint16(END)).astype("<u2")
                    rows.append((None if doc is None else int(doc), out, len(classes), int(len(own) - odd.sum()), float(logs[own].sum()), classes.tobytes(), hashes[own[odd]].tobytes()))
                out = pd.DataFrame(rows, columns=["doc_id", "held_out", "n_tokens", "n_frequent", "log_frequent", "classes", "others"])
                yield out.astype({"doc_id": "Int64"})

    schema = "doc_id long, held_out boolean, n_tokens long, n_frequent long, log_frequent double, classes binary, others binary"
    return texts.mapInPandas(run, schema).withColumn("row", F.monotonically_increasing_id())


def other_words(rows: DataFrame, counts: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Per row: known words that are not frequent, and their sum of log10(count + 1), by a join on the word."""

    def run(batches):
        for batch in batches:
            words = [np.frombuffer(x, np.int64) for x in batch["others"]]
            yield pd.DataFrame({"row": np.repeat(batch["row"].to_numpy(), [len(w) for w in words]), "word": np.concatenate(words) if words else np.zeros(0, np.int64)})

    least = int(vocab.counts.min()) if len(vocab.counts) else 1 << 62
    met = rows.select("row", "others").mapInPandas(run, "row long, word long")
    known = met.join(counts.where(F.col("n") < least), "word")
    return known.groupBy("row").agg(F.count("*").alias("n_other"), F.sum(F.log10(F.col("n") + 1.0)).alias("log_other"))


@dataclass
class Model:
    """start and move: state probabilities; rise: emission of a class by a state over the class's share of all tokens."""

    start: np.ndarray
    move: np.ndarray
    rise: np.ndarray


def first_model(shares: np.ndarray, states: int = STATES, seed: int = SEED) -> Model:
    rise = np.exp(np.random.default_rng(seed).normal(0, 0.7, (len(shares), states)))
    rise /= shares @ rise
    move = np.full((states, states), 0.05 / max(1, states - 1))
    np.fill_diagonal(move, 0.95 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, rise)


class Chunks:
    """The tokens of some texts in chunks, longest chunk first, so that those still running are the first ones.

    All chunks step together. Into a text's first chunk and out of its last, vectors of states are enough. Only a chunk
    between two others needs the product of its step matrices, which takes any states before it to the states after it;
    with these, the recursion over a long text runs from chunk to chunk.
    """

    def __init__(self, sequences: list[np.ndarray], model: Model):
        self.model, self.texts = model, len(sequences)
        sizes = np.array([len(s) for s in sequences])
        parts = -(-sizes // CHUNK)
        text = np.repeat(np.arange(len(sizes)), parts)
        place = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        lengths = np.minimum(CHUNK, sizes[text] - place * CHUNK)
        order = np.argsort(-lengths, kind="stable")
        self.lengths, self.text, self.place = lengths[order], text[order], place[order]
        self.steps = int(self.lengths[0])
        self.running = np.searchsorted(-self.lengths, -np.arange(self.steps))
        tokens = np.concatenate(sequences).astype(np.int64)
        starts = (np.cumsum(sizes) - sizes)[self.text] + self.place * CHUNK
        # By step, then chunk; beyond a chunk's end stands any token, which no step reads.
        self.tokens = tokens[np.minimum(starts + np.arange(self.steps)[:, None], len(tokens) - 1)]
        self.rise = model.rise[self.tokens]
        last = self.place == parts[self.text] - 1
        self.firsts, self.lasts = np.flatnonzero(self.place == 0), np.flatnonzero(last & (self.place > 0))
        middle = np.flatnonzero(~last & (self.place > 0))
        # Middle chunks of a text in order: those at place 1, 2 and so on.
        by = middle[np.argsort(self.place[middle], kind="stable")]
        self.at_place = np.split(by, np.cumsum(np.bincount(self.place[by])[1:])[:-1]) if len(by) else []
        self._products(middle)

    def _still(self, own: np.ndarray, t: int) -> int:
        """How many of these chunks, in order, have a token at step t."""
        return int(np.searchsorted(own, self.running[t]))

    def _products(self, own: np.ndarray):
        k = len(self.model.start)
        m = np.broadcast_to(np.eye(k), (len(own), k, k)).copy()
        log = np.zeros(len(own))
        for t in range(self.steps if len(own) else 0):
            n = self._still(own, t)
            m[:n] = (m[:n].reshape(-1, k) @ self.model.move).reshape(n, k, k) * self.rise[t, own[:n], None, :]
            if t % 8 == 7 or t == self.steps - 1:
                scale = m.reshape(-1, k * k) @ np.ones(k * k)
                m /= scale[:, None, None]
                log += np.log(scale)
        self.product, self.log = np.zeros((len(self.lengths), k, k)), np.zeros(len(self.lengths))
        self.product[own], self.log[own] = m, log

    def _through(self, own: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after these chunks from those before, and the logs of their scales."""
        a, log, ones = states.copy(), np.zeros(len(own)), np.ones(states.shape[1])
        for t in range(int(self.lengths[own[0]]) if len(own) else 0):
            n = self._still(own, t)
            a[:n] = (a[:n] @ self.model.move) * self.rise[t, own[:n]]
            if t % 8 == 7 or t == self.steps - 1:
                scale = a @ ones
                a /= scale[:, None]
                log += np.log(scale)
        scale = a @ ones
        return a / scale[:, None], log + np.log(scale)

    def forward(self) -> np.ndarray:
        """Natural log of each text's likelihood over its class shares; `before` gets the states before each chunk."""
        alpha = np.tile(self.model.start, (self.texts, 1))
        out = np.zeros(self.texts)
        self.before = np.zeros((len(self.lengths), alpha.shape[1]))
        for own, matrices in [(self.firsts, False), *((m, True) for m in self.at_place), (self.lasts, False)]:
            texts = self.text[own]
            self.before[own] = alpha[texts]
            if matrices:
                a = np.einsum("ni,nij->nj", alpha[texts], self.product[own])
                scale = a.sum(axis=1)
                alpha[texts], log = a / scale[:, None], np.log(scale) + self.log[own]
            else:
                alpha[texts], log = self._through(own, alpha[texts])
            out[texts] += log
        return out

    def backward(self):
        """`after` gets what the rest of the text says of the states after each chunk."""
        beta = np.ones((self.texts, len(self.model.start)))
        self.after = np.ones((len(self.lengths), beta.shape[1]))
        b = beta[self.text[self.lasts]]
        for t in reversed(range(int(self.lengths[self.lasts[0]]) if len(self.lasts) else 0)):
            n = self._still(self.lasts, t)
            b[:n] = (b[:n] * self.rise[t, self.lasts[:n]]) @ self.model.move.T
            if t % 8 == 0:
                b[:n] /= (b[:n] @ np.ones(b.shape[1]))[:, None]
        beta[self.text[self.lasts]] = b
        for own in reversed(self.at_place):
            texts = self.text[own]
            self.after[own] = beta[texts]
            b = np.einsum("nij,nj->ni", self.product[own], beta[texts])
            beta[texts] = b / b.sum(axis=1, keepdims=True)
        self.after[self.firsts] = beta[self.text[self.firsts]]

    def expected(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected first states, moves and emissions of all texts."""
        self.forward()
        self.backward()
        model, k, count = self.model, len(self.model.start), len(self.lengths)
        ones = np.ones(k)
        # By step and chunk, and zero beyond a chunk's end: states before a step, after its move, and what token and rest say.
        alpha, moved, rest = (np.zeros((self.steps, count, k)) for _ in range(3))
        a = self.before
        for t in range(self.steps):
            n = self.running[t]
            alpha[t, :n] = a[:n]
            np.matmul(a[:n], model.move, out=moved[t, :n])
            a = moved[t, :n] * self.rise[t, :n]
            if t % 8 == 7:
                a /= (a @ ones)[:, None]
        beta = self.after.copy()
        for t in reversed(range(self.steps)):
            n = self.running[t]
            np.multiply(self.rise[t, :n], beta[:n], out=rest[t, :n])
            np.matmul(rest[t, :n], model.move.T, out=beta[:n])
            if t % 8 == 0:
                beta[:n] /= (beta[:n] @ ones)[:, None]
        moved *= rest
        norm = (moved @ ones)[:, :, None]
        norm[norm == 0] = 1.0
        moved /= norm
        alpha /= norm
        moves = alpha.reshape(-1, k).T @ rest.reshape(-1, k)
        g = self.before[self.firsts] * beta[self.firsts]
        starts = (g / g.sum(axis=1, keepdims=True)).sum(axis=0)
        tokens = self.tokens.ravel()
        emitted = np.stack([np.bincount(tokens, weights=moved[:, :, s].ravel(), minlength=CLASSES) for s in range(k)], axis=1)
        return starts, moves * model.move, emitted


def _groups(batches, column="classes"):
    """Rows of the batches in groups of about TOGETHER tokens, of texts of like length."""
    for batch in batches:
        sequences = [np.frombuffer(x, "<u2") for x in batch[column]]
        sizes = np.array([len(s) for s in sequences])
        order = np.argsort(-sizes, kind="stable")
        group = np.cumsum(sizes[order]) // TOGETHER
        for at in np.split(order, np.flatnonzero(np.diff(group)) + 1):
            if len(at):
                yield batch.iloc[at], [sequences[i] for i in at]


def baum_welch(rows: DataFrame, vocab: Vocabulary, states: int = STATES, rounds: int = ROUNDS, seed: int = SEED) -> Model:
    """Each round, tasks add up the expected counts of their texts; (classes + states + 1) x states numbers reach the driver."""
    shares = vocab.weights / vocab.weights.sum()
    model = first_model(shares, states, seed)
    names = [f"s{i}" for i in range(states)]
    # Ids of the rows that hold counts: classes, then the states moved from, then the first states.
    size = CLASSES + states + 1
    for _ in range(rounds):

        def run(batches, model=model):
            total = np.zeros((size, states))
            for _, sequences in _groups(batches):
                starts, moves, emitted = Chunks(sequences, model).expected()
                total[:CLASSES] += emitted
                total[CLASSES:-1] += moves
                total[-1] += starts
            at = np.flatnonzero(total.any(axis=1))
            yield pd.DataFrame(total[at], columns=names).assign(id=at.astype(np.int32))

        sums = rows.where("NOT held_out").select("classes").mapInPandas(run, ", ".join(f"{n} double" for n in names) + ", id int")
        got = sums.groupBy("id").agg(*(F.sum(n).alias(n) for n in names)).toPandas()
        total = np.zeros((size, states))
        total[got["id"].to_numpy()] = got[names].to_numpy()
        emitted = total[:CLASSES] + PRIOR * shares[:, None]
        emitted /= emitted.sum(axis=0)
        move = total[CLASSES:-1] + MOVES
        start = total[-1] + MOVES
        # Classes without weight cannot occur.
        rise = np.divide(emitted, shares[:, None], out=np.ones_like(emitted), where=shares[:, None] > 0)
        model = Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), rise)
    return model


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, one row per input row.

    The model's word probability is its class probability given the states, times the word's share of its class: add-one
    counts, with one unknown word in each shared class. Words are told apart by 64-bit hashes; equally frequent ones go by
    hash. Null and empty texts are the end token alone; very long texts run whole, chunk by chunk; a null id counts as
    empty; repeated rows are scored and learned each; without training rows every word is unknown; an empty table gives no
    rows; other columns, whatever their names, are ignored.
    """
    texts = _texts(docs, id_col, text_col)
    counts = written(word_counts(texts), "counts")
    training_docs = texts.where("NOT held_out").count()
    vocab = vocabulary(counts, training_docs)
    rows = written(coded(texts, vocab), "coded")
    model = baum_welch(rows, vocab, states, rounds, seed)

    def run(batches):
        for part, sequences in _groups(batches):
            likelihood = Chunks(sequences, model).forward()
            yield pd.DataFrame({"row": part["row"].to_numpy(), "gain": likelihood / math.log(10)})

    gain = rows.select("row", "classes").mapInPandas(run, "row long, gain double")
    other = other_words(rows, counts, vocab)
    end_known, end_log = int(training_docs > 0), math.log10(training_docs + 1)
    base, full = math.log10(vocab.tokens + vocab.distinct + 1), math.log10(vocab.total)
    seen = F.col("log_frequent") + F.coalesce("log_other", F.lit(0.0)) + F.lit(end_log)
    out = rows.select("row", "doc_id", "held_out", "n_tokens", "n_frequent", "log_frequent").join(gain, "row").join(other, "row", "left")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_frequent") + F.coalesce("n_other", F.lit(0)) + end_known).cast("long").alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (seen - F.col("n_tokens") * base).alias("base_score"),
        (seen - F.col("n_tokens") * full + F.col("gain")).alias("score"),
    )

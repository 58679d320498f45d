"""Language ID by error-correcting output codes over binary n-gram classifiers."""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from tintwell.llm.common import give_back, slices

#: Lengths of the byte n-grams, and buckets of each length.
ORDERS, BUCKETS = (2, 3, 4), 4096
#: Codewords of all two-way splits up to this many languages; beyond, seeded random splits, this many per bit of information.
EXHAUSTIVE, BITS_PER_LOG2 = 6, 12
UNKNOWN = "und"
#: A decision is ambiguous when the runner-up's loss is within this share of the winner's.
AMBIGUOUS = 0.02

_FOLD = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_PLAIN_LETTER = re.compile("[A-Za-z]")
_RUN = re.compile(rb" +")
_FACTOR = np.uint32(2654435761)


def grams(text: str) -> np.ndarray:
    """Bucket of every n-gram of the folded text: lower case, with a blank for each run of ASCII other than letters."""
    data = b" " + _RUN.sub(b" ", text.lower().encode("utf-8", "replace").translate(_FOLD)).strip() + b" "
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    out = []
    for k, n in enumerate(ORDERS):
        if len(b) >= n:
            h = b[: len(b) - n + 1].copy()
            for j in range(1, n):
                h = (h << np.uint32(8)) | b[j : len(b) - n + 1 + j]
            h = h * _FACTOR
            out.append((h >> np.uint32(32 - BUCKETS.bit_length() + 1)) + np.uint32(k * BUCKETS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1. Every split of the languages in two while there are few; seeded random splits otherwise."""
    if n <= 1:
        return np.ones((n, 1), dtype=np.int8)
    if n <= EXHAUSTIVE:
        splits = [s for s in itertools.product((1, -1), repeat=n) if s[0] == 1 and -1 in s]
        return np.array(splits, dtype=np.int8).T
    rng = np.random.default_rng(7)
    code = rng.choice(np.array([1, -1], dtype=np.int8), size=(n, int(np.ceil(BITS_PER_LOG2 * np.log2(n)))))
    return code[:, np.abs(code.sum(axis=0)) < n]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    #: Log odds of each n-gram for each bit, and weight of each bit's loss.
    odds: np.ndarray
    weight: np.ndarray


def gram_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, gram, n) over all rows with a language; tasks add up before the shuffle."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            for lang, text in zip(batch["lang"], batch["text"]):
                if lang not in sums:
                    sums[lang] = np.zeros(len(ORDERS) * BUCKETS, dtype=np.int64)
                g = grams(text)
                if len(g) < 8 * BUCKETS:
                    np.add.at(sums[lang], g, 1)
                else:
                    sums[lang] += np.bincount(g, minlength=len(ORDERS) * BUCKETS)
        for lang, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": lang, "gram": at.astype(np.int32), "n": counts[at]})

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts n-grams over all labelled rows; the driver sees languages x buckets numbers, whatever the size of the data.

    The classifier of a bit compares the mean profiles of the languages on its two sides. A bit's loss weighs as much
    as its weakest language lies on the right side.
    """
    counts = gram_counts(docs, text_col, lang_col).toPandas()
    languages = sorted(counts["lang"].unique())
    profile = np.ones((len(languages), len(ORDERS) * BUCKETS))
    for at, lang in enumerate(languages):
        own = counts[counts["lang"] == lang]
        profile[at, own["gram"].to_numpy()] += own["n"].to_numpy()
    code = codewords(len(languages))
    if len(languages) < 2:
        return Model(languages, code, np.zeros((profile.shape[1], 1), np.float32), np.ones(1))
    profile /= profile.sum(axis=1, keepdims=True)
    odds = np.stack([np.log(profile[code[:, b] > 0].mean(axis=0) / profile[code[:, b] < 0].mean(axis=0)) for b in range(code.shape[1])], axis=1)
    margin = (profile @ odds * code).min(axis=0)
    weight = np.maximum(margin, 1e-3)
    return Model(languages, code, odds.astype(np.float32), weight / weight.sum())


def decode(model: Model, text: str | None) -> tuple[str, float, bool]:
    """Language, its score and whether it is ambiguous.

    Each codeword loses, weighted by bit, what the classifiers say against it; the nearest one has the smallest loss.
    """
    if text is None or not model.languages or not (_PLAIN_LETTER.search(text) or any(map(str.isalpha, text))):
        return UNKNOWN, 0.0, True
    if len(model.languages) == 1:
        return model.languages[0], 1.0, False
    g = grams(text)
    said = np.zeros(model.code.shape[1])
    for at in range(0, len(g), 65536):
        said += model.odds[g[at : at + 65536]].sum(axis=0, dtype=np.float64)
    said /= np.sqrt(max(1, len(g)))
    loss = (np.logaddexp(0, -model.code * said) * model.weight).sum(axis=1)
    order = np.argsort(loss, kind="stable")
    share = np.exp(loss[order[0]] - loss)
    gap = loss[order[1]] - loss[order[0]]
    return model.languages[order[0]], float(1 / share.sum()), bool(gap <= AMBIGUOUS * loss[order[1]])


_PREDICTION = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("ambiguous", BooleanType())])


def predict(model: Model, text: Column) -> Column:
    """Struct of lang_pred, score and ambiguous; the text is all it reads."""

    @F.pandas_udf(_PREDICTION)
    def run(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([decode(model, t) for t in texts], columns=["lang_pred", "score", "ambiguous"])
        give_back()
        return out

    return run(text)


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of every row, learned from the rows that are not held out.

    `und` with score 0 for null and empty texts, texts without a letter, and where nothing can be learned. Very long texts
    are read whole. Of languages with the same loss the first by name is predicted. Rows without a language are predicted
    and not learned from; repeated rows count each; a null id counts as empty; an empty table gives no rows; other columns,
    whatever their names, are ignored.
    """
    model = train(docs.where(~held_out(F.col(id_col))), text_col, lang_col)
    out = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), predict(model, F.col(text_col)).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.ambiguous")


def identified_documents(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose language can be told, with the columns of the input; those with null, empty or ambiguous texts go."""
    model = train(docs, text_col, lang_col)
    out = docs.select(F.struct(*docs.columns).alias("row"), predict(model, F.col(text_col)).alias("p"))
    return out.where((F.col("p.lang_pred") != UNKNOWN) & ~F.col("p.ambiguous")).select("row.*")

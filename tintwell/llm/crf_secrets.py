"""Secret scan: fixed patterns, and more spans from a linear-chain conditional random field."""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintwell.llm.common import written

# The patterns of the base spans and the least lengths of what they match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "crf")

OUT, BEGIN, INSIDE = 0, 1, 2
#: Documents a model is fitted on, a share of which gives windows without a secret; most windows with a secret and most
#: without one, of all documents and of each.
SAMPLE, NEGATIVES, WINDOWS, OF_EACH = 20_000, 4, 10_000, 8
#: Tokens on each side of a window's middle, rounds and step of fitting, and the weight of squared weights.
SIDE, ROUNDS, STEP, RIDGE = 8, 150, 0.3, 1e-3
#: Tokens a task remembers (those met first), their most characters, and texts decoded together.
TOKENS_KEPT, TOKEN_CHARS, TOGETHER = 800_000, 64, 1024

_HINT = re.compile(r"pass(word|wd|phrase)|secret|token|api_?key|credential|auth", re.IGNORECASE | re.ASCII)
_SIGN = re.compile(r"""^["']?[:=]["']?$""")
_JOINED = re.compile(r"""[A-Za-z_]["']?[:=]["']?[A-Za-z0-9+/_.=-]""")
_HIT = re.compile(f"(?i:{_HINT.pattern})|AKIA|[0-9a-f]{{16}}", re.ASCII)
_SPACES = re.compile(r"\S+")
_EDGE = "\"'`()[]{}<>,;:.!?#$%&*"
#: Upper ends of the classes of a token's length.
SIZES = [4, 8, 12, 16, 20, 32, 64]
#: Roles of a token for its neighbours: none, hint word, sign, hint word with a sign, has digits and letters.
ROLES = 5


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, leftmost and not overlapping within a kind, in code points."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    return out + [("hex", *m.span()) for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]


def joined(spans: list[tuple[str, int, int]]) -> str:
    order = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in order)


def shape(token: str) -> tuple[int, ...]:
    """Feature numbers of a token: length, kinds of characters, share of digits, symbols, hint words, an assignment."""
    core = token.strip(_EDGE)
    value = re.split("[:=]", core)[-1] if _JOINED.search(core) else core
    n = len(value)
    digits = sum("0" <= c <= "9" for c in value)
    kinds = (any("a" <= c <= "z" for c in value)) + 2 * any("A" <= c <= "Z" for c in value) + 4 * (digits > 0) + 8 * any(c > "\x7f" for c in value)
    share = 0 if not digits else 1 if digits * 5 < n else 2 if digits * 2 < n else 3
    size = bisect.bisect_right(SIZES, n)
    symbols = sum(c in "+/_=-" for c in value)
    return size, 8 + kinds, 24 + share, 28 + min(symbols, 2), 31 + bool(_HINT.search(core)), 33 + bool(_JOINED.search(core)), 35 + kinds * 8 + size


OWN = 35 + 16 * 8


def role(token: str) -> int:
    hint, sign = bool(_HINT.search(token)), bool(_SIGN.match(token)) or token[-1] in ":="
    if hint or sign:
        return hint + 2 * sign
    return 4 if any(c.isdigit() for c in token) and any(c.isalpha() for c in token) else 0


@dataclass
class Model:
    """Weights by tag: of a token's own features, of the roles one and two before and one after, of the file, of moves."""

    own: np.ndarray
    before: np.ndarray
    before2: np.ndarray
    after: np.ndarray
    file: np.ndarray
    move: np.ndarray

    @classmethod
    def zero(cls) -> Model:
        return cls(*(np.zeros((n, 3)) for n in (OWN, ROLES, ROLES, ROLES, 4, 3)))

    def parts(self) -> list[np.ndarray]:
        return [self.own, self.before, self.before2, self.after, self.file, self.move]


def file_feature(roles: np.ndarray) -> int:
    """Quarter-octave class of the share of a text's tokens that are signs, hints or mix digits and letters."""
    share = float((roles > 0).mean()) if len(roles) else 0.0
    return int(np.searchsorted([0.002, 0.02, 0.1], share, side="right"))


def may_hit(token: str) -> bool:
    """Whether a base pattern may begin in this token."""
    return bool(_HIT.search(token))


def described(token: str) -> tuple[tuple[int, ...], int, bool]:
    """shape, role and may_hit of a token; words of plain letters, which most are, take a short way to the same."""
    core = token.strip(_EDGE)
    if not (core.isalpha() and core.isascii()) or _HIT.search(token):
        return shape(token), role(token), may_hit(token)
    kinds = (not core.isupper()) + 2 * (not core.islower())
    size = bisect.bisect_right(SIZES, len(core))
    sign = token[-1] == ":" or token[-1] == "="
    return (size, 8 + kinds, 24, 28, 31, 33, 35 + kinds * 8 + size), 2 * sign, False


class Tokens(dict):
    """Numbers the descriptions of tokens, each of which is made once while its token is remembered.

    Far fewer descriptions than tokens differ, so scores, roles and hits are kept by description.
    """

    def __init__(self, model: Model | None):
        self.model = model
        self.number: dict[tuple, int] = {}
        self.score, self.role, self.hit = np.zeros((0, 3)), np.zeros(0, np.int8), np.zeros(0, bool)

    def __missing__(self, token: str) -> int:
        what = described(token)
        at = self.number.setdefault(what, len(self.number))
        if len(self) < TOKENS_KEPT and len(token) <= TOKEN_CHARS:
            self[token] = at
        return at

    def numbered(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = [t.split() for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter(map(self.__getitem__, itertools.chain.from_iterable(split)), np.int64, sizes.sum())
        if new := list(self.number)[len(self.role) :]:
            self.score = np.concatenate([self.score, self.model.own[np.array([x[0] for x in new])].sum(axis=1)])
            self.role = np.concatenate([self.role, np.array([x[1] for x in new], np.int8)])
            self.hit = np.concatenate([self.hit, np.array([x[2] for x in new], bool)])
        return at, sizes


def _shifted(roles: np.ndarray, starts: np.ndarray, ends: np.ndarray, by: int) -> np.ndarray:
    """Role `by` tokens on inside the same text, 0 beyond it."""
    out = np.zeros_like(roles)
    if by > 0:
        out[:-by] = roles[by:]
        for k in range(1, by + 1):
            out[(ends - k)[ends - k >= starts]] = 0
    else:
        out[-by:] = roles[:by]
        for k in range(-by):
            out[(starts + k)[starts + k < ends]] = 0
    return out


def viterbi(scores: list[np.ndarray], move: np.ndarray) -> list[np.ndarray]:
    """The best tags of each sequence; all sequences step together, the longest first."""
    order = np.argsort([-len(s) for s in scores], kind="stable")
    lengths = np.array([len(scores[i]) for i in order])
    out = [np.zeros(len(s), np.int8) for s in scores]
    steps = int(lengths[0]) if len(lengths) else 0
    if not steps:
        return out
    flat = np.concatenate([scores[i] for i in order])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    running = np.searchsorted(-lengths, -np.arange(steps), side="left")
    best = flat[starts[: running[0]]].copy()
    back = np.zeros((len(flat), 3), np.int8)
    for t in range(1, steps):
        n = running[t]
        way = best[:n, :, None] + move[None]
        at = starts[:n] + t
        pick = way.argmax(axis=1)
        back[at] = pick
        best[:n] = np.take_along_axis(way, pick[:, None, :], axis=1)[:, 0] + flat[at]
    tag = best.argmax(axis=1)
    # Only paths that leave `outside` somewhere need to be walked back; a path that ends outside may still have left it.
    for k, i in enumerate(order):
        n, s, now = lengths[k], starts[k], tag[k] if lengths[k] else 0
        steps_back = back[s : s + n]
        if now == OUT and not steps_back[:, OUT].any():
            continue
        for t in range(n - 1, -1, -1):
            out[i][t] = now
            now = steps_back[t, now]
    return out


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _drawn(doc_id, place: int = -1) -> int:
    """A number that depends on the document and a place in it alone."""
    return int.from_bytes(hashlib.md5(f"{doc_id}:{place}".encode()).digest()[:7], "big")


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """words, tags and file around tokens of base spans, and around other tokens of a share of the texts; secret and draw.

    A document gives at most OF_EACH windows with a secret and as many without one, those of the smallest draw.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                words = text.split()
                spans = base_spans(text)
                draw = _drawn(doc_id)
                if not words or not spans and draw % NEGATIVES:
                    continue
                at = [m.span() for m in _SPACES.finditer(text)]
                lo, hi = np.array(at).T
                tags = np.zeros(len(words), np.int8)
                middles = set()
                for _, a, b in sorted(spans, key=lambda s: s[1]):
                    own = slice(int(np.searchsorted(hi, a, side="right")), int(np.searchsorted(lo, b)))
                    tags[own] = np.where(tags[own] == OUT, INSIDE, tags[own])
                    if own.start == 0 or tags[own.start - 1] == OUT:
                        tags[own.start] = BEGIN
                    middles.add(own.stop - 1)
                if draw % NEGATIVES == 0:
                    odd = [i for i, w in enumerate(words) if not tags[i] and (role(w) or len(w) > 15)]
                    middles |= set(odd[draw % len(odd) :][:1] if odd else [])
                    middles.add(draw % len(words))
                roles = np.array([role(w) for w in words])
                file = file_feature(roles)
                # Hint words before a mixed token that no pattern takes: perhaps a secret, so no example of none.
                mixed = np.append(roles, [0, 0]) == 4
                doubt = np.flatnonzero((roles % 2 == 1) & (tags == OUT) & (mixed[1:-1] | mixed[2:]))
                taken = {True: 0, False: 0}
                for key, m in sorted((_drawn(doc_id, m), m) for m in middles):
                    a, b = max(0, m - SIDE), m + SIDE + 1
                    secret = bool(tags[a:b].any())
                    if taken[secret] < OF_EACH and np.searchsorted(doubt, a) == np.searchsorted(doubt, b):
                        rows.append((words[a:b], tags[a:b].tolist(), file, secret, key))
                        taken[secret] += 1
            yield pd.DataFrame(rows, columns=["words", "tags", "file", "secret", "draw"])

    return _texts(docs, id_col, text_col).mapInPandas(run, "words array<string>, tags array<int>, file int, secret boolean, draw long")


def fit(rows: pd.DataFrame) -> Model:
    """Maximises the likelihood of the windows' tags by gradient steps with momentum scaled by past gradients."""
    model = Model.zero()
    if not len(rows):
        model.own[:, OUT] = 1.0
        return model
    n, width = len(rows), 2 * SIDE + 1
    own, tags, live = np.zeros((n, width, 7), np.int64), np.zeros((n, width), np.int64), np.zeros((n, width), bool)
    roles = np.zeros((n, width + 3), np.int64)
    memory: dict[str, tuple] = {}
    for r, (words, t) in enumerate(zip(rows["words"], rows["tags"])):
        for k, w in enumerate(words):
            if w not in memory:
                memory[w] = (shape(w), role(w))
            own[r, k], roles[r, k + 2] = memory[w]
        tags[r, : len(t)], live[r, : len(t)] = t, True
    file = np.repeat(rows["file"].to_numpy(np.int64)[:, None], width, axis=1)
    ids = [own, roles[:, 1:-2], roles[:, :-3], roles[:, 3:], file]
    first, second = [np.zeros_like(p) for p in model.parts()], [np.zeros_like(p) for p in model.parts()]
    eye = np.eye(3)
    for step in range(1, ROUNDS + 1):
        e = model.own[own].sum(axis=2) + model.before[ids[1]] + model.before2[ids[2]] + model.after[ids[3]] + model.file[file]
        # Each token's factors are scaled to 1 at most, and each step's states to a sum of 1; posteriors do not change.
        psi, move = np.exp(e - e.max(axis=2, keepdims=True)), np.exp(model.move - model.move.max())
        alpha, beta = np.empty((n, width, 3)), np.ones((n, width, 3))
        alpha[:, 0] = psi[:, 0]
        for t in range(1, width):
            a = (alpha[:, t - 1] @ move) * psi[:, t]
            alpha[:, t] = np.where(live[:, t, None], a / a.sum(axis=1, keepdims=True), alpha[:, t - 1])
        for t in range(width - 2, -1, -1):
            b = (psi[:, t + 1] * beta[:, t + 1]) @ move.T
            beta[:, t] = np.where(live[:, t + 1, None], b / b.sum(axis=1, keepdims=True), 1.0)
        both = alpha * beta
        wrong = (eye[tags] - both / both.sum(axis=2, keepdims=True)) * live[:, :, None]
        grads = [np.zeros_like(p) for p in model.parts()]
        for j in range(own.shape[2]):
            _add(grads[0], own[:, :, j], wrong)
        for g, i in zip(grads[1:5], ids[1:]):
            _add(g, i, wrong)
        for t in range(1, width):
            on = live[:, t]
            x, y = alpha[on, t - 1], psi[on, t] * beta[on, t]
            norm = ((x @ move) * y).sum(axis=1, keepdims=True)
            grads[5] += eye[tags[on, t - 1]].T @ eye[tags[on, t]] - ((x / norm).T @ y) * move
        for p, g, m, v in zip(model.parts(), grads, first, second):
            g = g / n - RIDGE * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += STEP * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def _add(out: np.ndarray, ids: np.ndarray, values: np.ndarray):
    for tag in range(3):
        out[:, tag] += np.bincount(ids.ravel(), weights=values[:, :, tag].ravel(), minlength=len(out))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Fits the field to the base spans of a bounded sample of texts, picked by a hash of their ids."""
    total = max(1, docs.count())
    share = min(1 << 30, int(sample / total * (1 << 30)) + 1)
    picked = docs.where(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)) < share)
    found = written(windows(picked, id_col, text_col), "windows")
    # Which windows are taken, and their order, depend on the documents alone, not on how tasks deliver them.
    parts = [found.where(F.col("secret") == secret).orderBy("draw", "words").limit(WINDOWS) for secret in (True, False)]
    rows = parts[0].unionByName(parts[1]).toPandas()
    rows["key"] = rows["words"].map(lambda w: "\t".join(w))
    return fit(rows.sort_values(["draw", "key"], kind="stable").reset_index(drop=True))


def _field_spans(text: str, tags: np.ndarray) -> list[tuple[int, int]]:
    """Spans of the tagged tokens, without marks at their edges."""
    out, at = [], None
    for k, m in enumerate(_SPACES.finditer(text)):
        if tags[k] == BEGIN or tags[k] == INSIDE and at is None:
            if at:
                out.append(at)
            at = m.span()
        elif tags[k] == INSIDE:
            at = (at[0], m.end())
        elif at:
            out.append(at)
            at = None
    if at:
        out.append(at)
    cut = [(a + len(s) - len(s.lstrip(_EDGE)), b - len(s) + len(s.rstrip(_EDGE))) for a, b in out for s in [text[a:b]]]
    return [(a, b) for a, b in cut if a < b]


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """doc_id, base (spans of the fixed patterns) and added (spans the field adds, none of which meets a base span), per row.

    Spans are structs of kind, start and end in code points of the whole text. Tokens are runs without white space. Null
    and empty texts have no spans; very long texts are tagged whole, as one sequence. Equally good tags: outside before
    begin before inside. A null id is kept, repeated rows are scanned each, an empty table gives no rows, and other
    columns, whatever their names, are ignored.
    """
    model = model or train(docs, id_col, text_col)
    span = "array<struct<kind:string,start:int,end:int>>"

    def run(batches):
        tokens = Tokens(model)
        for batch in batches:
            for a in range(0, len(batch), TOGETHER):
                part = batch.iloc[a : a + TOGETHER]
                texts = list(part["text"])
                at, sizes = tokens.numbered(texts)
                ends = np.cumsum(sizes)
                starts = ends - sizes
                roles = tokens.role[at]
                file = np.array([file_feature(roles[s:e]) for s, e in zip(starts, ends)], np.int64)
                score = tokens.score[at] + model.file[np.repeat(file, sizes)]
                if len(at):
                    score += model.before[_shifted(roles, starts, ends, -1)] + model.before2[_shifted(roles, starts, ends, -2)] + model.after[_shifted(roles, starts, ends, 1)]
                hits = np.add.reduceat(np.append(tokens.hit[at], False), np.minimum(starts, len(at))) * (sizes > 0)
                rows = []
                for doc_id, text, hit, tags in zip(part["doc_id"], texts, hits, viterbi([score[s:e] for s, e in zip(starts, ends)], model.move)):
                    base = base_spans(text) if hit else []
                    more = [("crf", s, e) for s, e in _field_spans(text, tags)] if tags.any() else []
                    more = [x for x in more if not any(x[1] < e and x[2] > s for _, s, e in base)]
                    named = lambda spans: [{"kind": k, "start": s, "end": e} for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0])))]
                    rows.append((None if doc_id is None else int(doc_id), named(base), named(more)))
                yield pd.DataFrame(rows, columns=["doc_id", "base", "added"]).astype({"doc_id": "Int64"})

    return _texts(docs, id_col, text_col).mapInPandas(run, f"doc_id long, base {span}, added {span}")


def digests(found: DataFrame) -> DataFrame:
    """Counts, digest and list of the spans of `secret_spans`."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    place = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("at"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("rank"), s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text(F.col("base")).cast("binary"), 256).alias("base_sha256"), text(place).alias("spans"))

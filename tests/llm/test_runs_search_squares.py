"""Periodic runs, ranked search and sum-of-squares packing against plain versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from tests.llm.conftest import COLUMNS, ODD, prose, rows_of
from tintwell.llm import periodic, square_packing, term_scan
from tintwell.llm.queries import tokenizer_path


def plain_runs(words, least=24, times=3):
    """Every stretch at every lag; one whose smallest period is smaller is not a run of this lag."""
    out, n = [], len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            s, length = i, j + q - i
            if length >= max(least, times * q) and not any(words[s : s + length - d] == words[s + d : s + length] for d in range(1, q)):
                out.append((s, length, q))
            i = j + 1
    return sorted(out)


def plain_words(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    h, n = 1 if doc_id is None else zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    return words


def plain_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic_text(rng, alphabet):
    """Repeats of blocks, whole, cut, nested and one after the other, between other words."""
    out = []
    for _ in range(rng.randint(1, 4)):
        block = [rng.choice(alphabet) for _ in range(rng.randint(1, 6))]
        if rng.random() < 0.4:
            block = block * rng.randint(2, 5) + [rng.choice(alphabet)]
        out += block * rng.randint(1, 8) + block[: rng.randint(0, len(block))]
        out += [rng.choice(alphabet) for _ in range(rng.choice([0, 0, 1, 7, 30]))]
    return out


def test_runs_against_all_lags():
    rng = random.Random(11)
    texts = [periodic_text(rng, ["ab", "abc", "abcdefgh"][i % 3]) for i in range(250)]
    texts += [[rng.choice("ab") for _ in range(120)] for _ in range(20)] + [["x"] * n for n in (0, 1, 23, 24, 200)]
    fib, last = "a", "b"
    while len(fib) < 300:
        fib, last = fib + last, fib
    texts += [list(fib), list("ab" * 11 + "a"), list("abc" * 8), list("abcdefgh" * 3), list("abcdefghi" * 3)[:-1]]
    got = periodic.runs_of([[w.encode() for w in t] for t in texts])
    found = 0
    for t, runs in zip(texts, got):
        assert runs == plain_runs(t)
        assert periodic.collapsed([w.encode() for w in t], runs).decode() == plain_collapsed(t, runs)
        found += len(runs)
    assert found > 250


def test_no_word_of_a_run_splits_its_segment():
    words = np.array([0, 1, 2] * 8 + [9] + list(range(10, 40)) + [0, 1, 2] * 7)
    assert periodic.stable_segments(words, np.zeros(len(words), int)) == [(0, 24)]
    # 5 is frequent in the text; only after 6 and 7 have split it is it rare in each part.
    words = np.array([5, *[1] * 30, 6, *[1] * 30, 5, 7, *[1] * 30, 5])
    assert periodic.stable_segments(words, np.zeros(len(words), int)) == [(1, 31), (32, 62), (64, 94)]
    assert periodic.stable_segments(np.zeros(0, int), np.zeros(0, int)) == []


def test_lag_scan_of_a_million_equal_words_and_of_many_runs():
    assert periodic.lag_scan(np.zeros(300_000, int)) == [(0, 300_000, 1)]
    words = np.concatenate([np.append(np.full(200, i % 2), 2 + i) for i in range(300)])
    assert periodic.lag_scan(words) == [(201 * i, 200, 1) for i in range(300)]


def test_runs_of_awkward_rows(odd, none):
    rows = periodic.run_digests(periodic.periodic_runs(periodic.with_planted_periods(odd))).collect()
    assert len(rows) == len(ODD)
    want = collections.Counter()
    for i, t, _, _ in ODD:
        words = plain_words(i, t)
        # The longest of the awkward texts has no period; its plain scan would take long.
        runs = plain_runs(words) if len(words) < 10_000 else []
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want[(i, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha(lines), sha(plain_collapsed(words, runs)))] += 1
    assert collections.Counter(map(tuple, rows)) == want
    assert periodic.run_digests(periodic.periodic_runs(periodic.with_planted_periods(none))).count() == 0


def test_planted_documents_against_all_lags(spark):
    texts = [(i, prose(i, 30 + 7 * (i % 60)), "en", "a") for i in range(500) if zlib.crc32(str(i).encode()) % 10 == 0 or i < 40]
    docs = spark.createDataFrame(rows_of(texts), COLUMNS)
    rows = {r.doc_id: r for r in periodic.periodic_runs(periodic.with_planted_periods(docs)).collect()}
    for i, t, _, _ in texts:
        words = plain_words(i, t)
        runs = plain_runs(words)
        assert [tuple(r) for r in rows[i].runs] == runs and rows[i].n_words == len(words)
        assert rows[i].collapsed == plain_collapsed(words, runs)
    assert sum(bool(r.runs) for r in rows.values()) >= 20


def plain_terms(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", lowered)


def plain_ranks(docs, items, k=20):
    terms = [(i, plain_terms(t)) for i, t in docs]
    terms = [(i, t, collections.Counter(t)) for i, t in terms if t]
    total = sum(len(t) for _, t, _ in terms)
    df = collections.Counter(x for _, _, c in terms for x in c)
    out = []
    for item_id, text in items:
        scored, asked = [], plain_terms(text)
        for i, t, c in terms:
            m = 75 + 25 * len(t) * len(terms) // total
            score = sum(math.floor(1000 * math.log((2 * len(terms) + 2) / (2 * df[x] + 1))) * (10**9 * c[x] // (1000 * c[x] + 12 * m)) for x in asked if c[x])
            scored.append((-score, i is None, i or 0))
        scored = sorted(s for s in scored if s[0] < 0)[:k]
        out += [(item_id, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(scored)]
    return sorted(out, key=str)


ITEMS = [(1, prose(1, 30) + " x 漢字"), (2, "Éàü, éàü; WORD word"), (3, None), (4, ""), (5, "no-such_term§"), (6, prose(3, 60)), (6, "7 ½ 345"), (None, "a word; the A"), (8, prose(2, 4000))]


def ranks(df):
    assert df.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("bound", [term_scan.BLOCK_BYTES, 2000])
def test_ranks_of_awkward_rows(odd, none, spark, monkeypatch, bound):
    monkeypatch.setattr(term_scan, "BLOCK_BYTES", bound)
    items = spark.createDataFrame([(i, t, 1, 2, "r") for i, t in ITEMS], "item_id long, text string, item long, rank long, doc_id string")
    docs = [(i, t) for i, t, _, _ in ODD]
    assert ranks(term_scan.ranked_search(odd, items)) == plain_ranks(docs, ITEMS)
    assert ranks(term_scan.ranked_search(odd, items, k=2)) == plain_ranks(docs, ITEMS, 2)
    assert ranks(term_scan.ranked_search(none, items)) == ranks(term_scan.ranked_search(odd, items.where("false"))) == []


def test_ranks_with_a_third_of_equal_documents(spark, monkeypatch):
    monkeypatch.setattr(term_scan, "ENTRIES", 500)
    texts = [(i, prose(7, 50) if i % 3 == 0 else prose(i, 20 + i % 90), "en", "a") for i in range(600)]
    items = [(i, prose(7 if i == 0 else 1000 + i, 12)) for i in range(30)]
    docs = spark.createDataFrame(rows_of(texts), COLUMNS).repartition(7)
    got = ranks(term_scan.ranked_search(docs, spark.createDataFrame(items, "item_id long, text string")))
    assert got == plain_ranks([(i, t) for i, t, _, _ in texts], items)
    assert [r[2] for r in sorted(got) if r[0] == 0] == list(range(0, 60, 3))


def test_only_whole_terms_are_counted():
    rows = [{"item": 0, "term": t, "times": 1} for t in ("a", "aa", "é", "1b")]
    block = term_scan.ItemTerms(rows)
    n, terms, tfs = term_scan.term_counts(block.automaton(), 4, "a A,aa\x00aaa é ée É 1B_1b a".encode())
    assert n == 10 and {block.terms[t]: c for t, c in zip(terms, tfs)} == {"a": 3, "aa": 1, "é": 1, "1b": 2}
    assert term_scan.term_counts(block.automaton(), 4, b" -")[0] == 0


def plain_squares(sizes, length):
    """Tries every open sequence and a new one, and sums the squares anew each time."""
    bins = []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        if sizes[item] == length:
            bins.append([item])
            continue
        best = None
        fill = [sum(sizes[i] for i in b) for b in bins]
        for at in range(len(bins) + 1):
            new = at == len(bins)
            now = (0 if new else fill[at]) + sizes[item]
            if now > length or not new and fill[at] == length:
                continue
            after = [*fill, 0] if new else list(fill)
            after[at] = now
            squares = sum(c * c for gap, c in collections.Counter(length - f for f in after).items() if gap)
            rank = (squares, new, length - now)
            if best is None or rank < best[0]:
                best = (rank, at)
        if best[1] == len(bins):
            bins.append([])
        bins[best[1]].append(item)
    return bins


def test_squares_against_trying_everything(monkeypatch):
    monkeypatch.setattr(square_packing.Squares, "dissolve", lambda self: None)
    rng = random.Random(3)
    for length in (8, 30, 64):
        for _ in range(30):
            sizes = [rng.randint(1, length) for _ in range(rng.randint(0, 40))]
            fills = lambda bins: sorted(sum(sizes[i] for i in b) for b in bins)
            got = [[i for i, _ in b] for b in square_packing.packed(np.array(sizes, int), length)]
            assert fills(got) == fills(plain_squares(sizes, length))
            assert sorted(i for b in got for i in b) == list(range(len(sizes)))


def test_dissolving_keeps_every_piece():
    rng = np.random.default_rng(1)
    for _ in range(50):
        sizes = rng.integers(1, 60, 80)
        got = square_packing.packed(sizes, 64)
        assert sorted(i for b in got for i, _ in b) == list(range(80)) and all(sum(n for _, n in b) <= 64 for b in got)
        assert all(n == sizes[i] for b in got for i, n in b)
        assert len(got) <= 1.1 * max(math.ceil(sizes.sum() / 64), (sizes > 32).sum()) + 1


def _check_squares(rows, texts):
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer_path())
    for i, t in texts:
        ids = np.array(tk.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        copies = sum(x[0] == i for x in texts)
        want = [(k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[i]) == sorted(want * copies)
    by_seq = collections.defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
    for places in by_seq.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 4096
    return by_seq


def test_square_packing_of_awkward_rows(odd, none):
    by_seq = _check_squares(square_packing.square_pack(odd, tokenizer_path()).collect(), [(i, t) for i, t, _, _ in ODD])
    assert len(by_seq) == math.ceil(sum(n for s in by_seq.values() for _, n in s) / 4096)
    assert square_packing.square_pack(none, tokenizer_path()).count() == 0


def test_square_packing_needs_few_sequences_in_groups(spark, monkeypatch):
    monkeypatch.setattr(square_packing, "GROUP_IDS", 400_000)
    texts = [(i, prose(i, 20 + i * i % 900)) for i in range(900)]
    rows = square_packing.square_pack(spark.createDataFrame(texts, "doc_id long, text string").repartition(5), tokenizer_path()).collect()
    by_seq = _check_squares(rows, texts)
    least = sum(r.length for r in rows) / 4096
    assert len({r.sequence_id >> 34 for r in rows}) > 1 and len(by_seq) <= 1.02 * least + 1

"""Operators that learn: secrets, languages, the language model; and the pipeline."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import COLUMNS, ODD, prose, rows_of
from tests.llm.test_near import classes_of, shingles
from tintwell.llm import crf_secrets, hmm, language, minhash
from tintwell.llm.common import table

SF = "/root/testdata/sf0.001"


def test_languages_of_held_out_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
    assert {r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in language.identify(docs).collect()} == {True}


def test_the_language_column_is_no_input_of_a_prediction(spark):
    docs = table(spark, SF, "documents")
    lang = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit("zz")).otherwise(F.col("lang"))
    a, b = (sorted(map(tuple, language.identify(d).collect())) for d in (docs, docs.withColumn("lang", lang)))
    assert a == b


def test_languages_of_awkward_rows(odd, none, spark):
    rows = language.identify(odd).collect()
    assert len(rows) == len(ODD)
    got = {r.doc_id: r.lang_pred for r in rows}
    assert all(got[i] == "und" for i in (1, 2, 3, 12, 15)) and got[9] == "de"
    assert language.identify(none).count() == 0
    untaught = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(untaught).collect()} == {"und"}
    one = odd.withColumn("lang", F.lit("xx"))
    assert {r.lang_pred for r in language.identify(one).collect()} == {"und", "xx"}


def test_codewords_differ_in_several_bits():
    for n in (2, 3, 4, 6, 9, 40):
        code = language.codewords(n).astype(int)
        apart = min((code[i] != code[j]).sum() for i, j in itertools.combinations(range(n), 2))
        assert apart >= (1 if n == 2 else 2 ** (n - 2) if n <= 6 else 8)
        assert (np.abs(code.sum(axis=0)) < n).all()


def test_base_spans_are_what_the_patterns_say():
    text = "é password = 'abcdefghijkl' PASSWORD:short token=0123456789abcdef01 AKIA" + "A" * 14 + "AKIAB " + "f" * 15 + " F" + "a" * 16 + "\nſecret=aaaaaaaaaaaaaaaa api-key=abcdefghijklmn api_key\":\"abcdefghijklmn"
    got = crf_secrets.base_spans(text)
    assert [text[a:b] for k, a, b in got if k == "assign"] == ["password = 'abcdefghijkl", "token=0123456789abcdef01", 'api_key":"abcdefghijklmn']
    assert [text[a:b] for k, a, b in got if k == "access"] == ["AKIA" + "A" * 14 + "AKIAB"]
    assert [text[a:b] for k, a, b in got if k == "hex"] == ["0123456789abcdef01", "a" * 16, "a" * 16]
    assert crf_secrets.joined([("hex", 3, 9), ("assign", 3, 9), ("crf", 1, 2)]) == "crf:1:2,assign:3:9,hex:3:9"


def test_secret_digests_against_the_patterns(spark):
    docs = table(spark, SF, "documents")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = crf_secrets.digests(crf_secrets.secret_spans(docs)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = crf_secrets.base_spans(texts[r.doc_id])
        kinds = collections.Counter(k for k, _, _ in base)
        assert (r.n_assign, r.n_access, r.n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert r.base_sha256 == hashlib.sha256(crf_secrets.joined(base).encode()).hexdigest()
        spans = [s for s in r.spans.split(",") if s]
        assert crf_secrets.joined(base) == ",".join(s for s in spans if not s.startswith("crf"))


def test_the_field_adds_secrets_the_patterns_miss(spark):
    rng = random.Random(5)
    key = lambda n: "".join(rng.choice("abcdef0123456789ABCDEFGHXYZ") for _ in range(n))
    texts = []
    for i in range(400):
        tail = f"token = \"{key(30)}\"" if i % 4 == 0 else f"password={key(20)}" if i % 4 == 1 else ""
        texts.append((i, f"{prose(i, 40)} {tail} {prose(i + 1000, 30)}", "en", "a"))
    probe = [(1000 + i, f"{prose(i, 30)} passphrase = \"{key(30)}\" {prose(i, 20)}", "en", "a") for i in range(40)]
    docs = spark.createDataFrame(rows_of(texts + probe), COLUMNS)
    rows = {r.doc_id: r for r in crf_secrets.secret_spans(docs).collect()}
    assert sum(bool(rows[1000 + i].added) for i in range(40)) >= 30
    assert sum(bool(rows[i].added) for i in range(400) if i % 4 > 1) <= 4
    assert all(not any(a.start < b.end and b.start < a.end for b in r.base) for r in rows.values() for a in r.added)


def test_secrets_of_awkward_rows(odd, none):
    assert len(crf_secrets.secret_spans(odd).collect()) == len(ODD)
    assert crf_secrets.digests(crf_secrets.secret_spans(none)).count() == 0


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    move = rng.normal(size=(3, 3))
    scores = [rng.normal(size=(n, 3)) * 2 for n in (5, 1, 0, 7, 7, 3)]
    for s, tags in zip(scores, crf_secrets.viterbi(scores, move)):
        value = lambda p, s=s: sum(s[t, k] for t, k in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:]))
        assert tuple(tags) == max(itertools.product(range(3), repeat=len(s)), key=value)


def plain_forward(seq, model):
    state, log = model.start, 0.0
    for c in seq:
        state = (state @ model.move) * model.rise[c]
        log += math.log(state.sum())
        state = state / state.sum()
    return log


def test_forward_recursion_and_expected_counts_are_exact():
    rng = np.random.default_rng(2)
    model = hmm.first_model(np.full(hmm.CLASSES, 1 / hmm.CLASSES), 3)
    seqs = [rng.integers(0, hmm.CLASSES, n).astype(np.uint16) for n in (1, 63, 64, 65, 300, 2)]
    chunks = hmm.Chunks(seqs, model)
    assert np.allclose(chunks.forward(), [plain_forward(s, model) for s in seqs])
    starts, moves, emitted = chunks.expected()
    want_s, want_m, want_e = np.zeros(3), np.zeros((3, 3)), np.zeros((hmm.CLASSES, 3))
    for s in seqs:
        alpha, beta = [model.start], [np.ones(3)]
        for c in s:
            alpha.append((alpha[-1] @ model.move) * model.rise[c])
        for c in s[::-1]:
            beta.append(model.move @ (model.rise[c] * beta[-1]))
        beta = beta[::-1]
        total = alpha[-1].sum()
        want_s += alpha[0] * beta[0] / total
        for t, c in enumerate(s):
            want_m += alpha[t][:, None] * model.move * (model.rise[c] * beta[t + 1])[None] / total
            want_e[c] += alpha[t + 1] * beta[t + 1] / total
    assert np.allclose(starts, want_s) and np.allclose(moves, want_m) and np.allclose(emitted, want_e)


def _base(texts):
    counts, tokens = collections.Counter(), {}
    for key, i, t in texts:
        tokens[key] = (t or "").encode().lower().split() + [None]
        if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2:
            counts.update(tokens[key])
    n, v = sum(counts.values()), len(counts)
    return {k: (len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)) for k, w in tokens.items()}


def test_base_scores_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hmm, "KNOWN", 300)
    docs = table(spark, SF, "documents")
    want = _base([(r.doc_id, r.doc_id, r.text) for r in docs.collect()])
    rows = hmm.score_documents(docs, rounds=2).collect()
    assert len(rows) == len(want)
    for r in rows:
        n, known, tokens, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, tokens) and math.isclose(r.base_score, base, rel_tol=1e-9)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_of_awkward_rows(odd, none):
    rows = hmm.score_documents(odd, rounds=1).collect()
    want = _base([(k, i, t) for k, (i, t, _, _) in enumerate(ODD)])
    assert sorted((r.n_tokens, r.n_known, r.train_tokens) for r in rows) == sorted(w[:3] for w in want.values())
    assert hmm.score_documents(none, rounds=1).count() == 0
    held = odd.where(hmm.held_out(F.col("doc_id")))
    got = hmm.score_documents(held, rounds=1).collect()
    assert got and all(r.train_tokens == 0 and r.base_score == 0 and r.n_known == 0 for r in got)


def test_pipeline_stages_act_on_what_they_get(spark):
    docs = table(spark, SF, "documents")
    longer = docs.where(F.length("text") > 2000).orderBy("doc_id").limit(5)
    docs = docs.unionByName(longer.withColumn("text", F.concat("text", F.lit(" more"))).withColumn("doc_id", F.col("doc_id") + 100_000))
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF)
        if name != "pack":
            assert after.columns == docs.columns
            assert after.join(before.select("doc_id").distinct(), "doc_id", "left_anti").isEmpty()
        if "dedup" in name:
            assert after.count() < before.count()
        before = spark.createDataFrame(after.collect(), after.schema)
    kept = corpus_pipeline.dedup_near(spark, docs, SF)
    near = lambda rows: minhash.near_classes(rows, percent=corpus_pipeline.NEAR_PERCENT)
    assert near(kept).where("NOT kept").isEmpty()
    assert kept.count() == near(docs).where("kept").count()


def test_pipeline_of_awkward_rows(odd, none, spark):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for rows in (docs, none.select(docs.columns)):
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, SF)
            rows = spark.createDataFrame(rows.collect(), rows.schema)
    clean = corpus_pipeline.identify(spark, table(spark, SF, "documents"), SF)
    assert clean.count() >= 0.98 * table(spark, SF, "documents").count()


def test_near_dedup_of_the_pipeline_against_all_pairs_at_four_fifths(spark):
    def edited(text, n, start):
        w = text.split()
        for k in range(n):
            w[start + 10 * k] = f"edit{start}x{k}"
        return " ".join(w)

    # An edit takes 5 of 200 shingles: 3, 4 and 5 edits give similarities 0.860, 0.818 and 0.778; a second edit of an edit chains.
    texts, between = {}, 0
    for g in range(60):
        base = prose(7000 + g, 204)
        once = edited(base, 3 + g % 3, 20)
        group = [base, once] + [edited(once, 4, 95)] * (g % 6 == 1)
        texts |= {1000 * g + k: t for k, t in enumerate(group)}
    sets, links = {i: shingles(t) for i, t in texts.items()}, []
    for a in texts:
        for b in texts:
            common = len(sets[a] & sets[b])
            if a < b and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                links.append((a, b))
                between += 100 * common < 85 * (len(sets[a]) + len(sets[b]) - common)
    assert between >= 20 and len(links) > between
    docs = spark.createDataFrame(rows_of((i, t, "en", "a") for i, t in texts.items()), COLUMNS).repartition(4)
    kept = [r.doc_id for r in corpus_pipeline.dedup_near(spark, docs, SF).select("doc_id").collect()]
    want = {i for i, c in classes_of(texts, links).items() if i == c}
    # No document of another class goes; 0.9936 of links at 0.80 are met, and of more similar ones more.
    assert len(kept) == len(set(kept)) and want <= set(kept)
    assert len(set(kept) - want) <= 0.02 * len(links)

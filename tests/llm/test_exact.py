"""Operators with an exact answer: dedup, archive, packing, mixing, licences."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import COLUMNS, ODD, prose, rows_of
from tintwell.llm import archive, exact_dedup, licenses, mixing, packing
from tintwell.llm.queries import tokenizer_path


def test_exact_groups_against_brute_force(odd):
    got = exact_dedup.exact_groups(odd).collect()
    assert len(got) == len(ODD)
    groups = defaultdict(list)
    for i, t, _, _ in ODD:
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i is None, i))
    want = {hashlib.sha256(k.encode()).hexdigest(): (min(v)[2], len(v)) for k, v in groups.items()}
    for r in got:
        keep, size = want[r.text_sha256]
        assert (r.keep_id, r.group_size, r.kept) == (keep, size, r.doc_id == keep)


def test_exact_groups_when_some_digests_are_frequent(spark):
    texts = [(i, "hot text" if i % 3 else f"text {i}" if i % 2 else f"pair {i // 12}", "en", "a") for i in range(3000)]
    docs = spark.createDataFrame(rows_of(texts), COLUMNS).repartition(5)
    got = {r.doc_id: r for r in exact_dedup.exact_groups(docs, counters=8).collect()}
    sizes = defaultdict(list)
    for i, t, _, _ in texts:
        sizes[t.replace(" ", "")].append(i)
    for i, t, _, _ in texts:
        own = sizes[t.replace(" ", "")]
        assert got[i].group_size == len(own)
    assert got[1].keep_id == 1 and got[1].group_size == 2000


def test_frequent_digests_are_few_and_have_every_heavy_one(spark):
    rows = spark.createDataFrame([(str(i % 7) if i % 2 else f"x{i}",) for i in range(5000)], "text_sha256 string").repartition(6)
    got = {r[0] for r in exact_dedup.frequent_digests(rows, 16).collect()}
    assert got <= {str(k) for k in range(7)} | {f"x{i}" for i in range(5000)} and len(got) <= 16
    assert not {r[0] for r in exact_dedup.frequent_digests(rows, 40).collect()} ^ {str(k) for k in range(7)}


def test_empty_tables(none, spark):
    assert exact_dedup.exact_groups(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert licenses.license_scan(none).count() == 0
    assert packing.pack(none, tokenizer_path()).count() == 0
    assert archive.archived_pages(none, id_col="doc_id", url_col="source", body_col="text").count() == 0


PAGES = [(1, "http://a", "x" * 1000), (2, "http://b\r\nEvil: yes", "x" * 1000), (3, None, "é" * 499), (4, "u", "é" * 499), (5, "u", None), (6, "u", ""), (7, "u", "y\r\n\r\nz" * 400), (7, "u", "y\r\n\r\nz" * 400), (None, "u", "x" * 1000), (8, "u", "é" * 500)]


def test_archive_against_brute_force(spark):
    pages = spark.createDataFrame([(*p, "clash", "clash") for p in PAGES], "page_id long, url string, html string, header string, digest string")
    got = sorted(((r.page_id is None, r.page_id or 0), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in archive.archived_pages(pages).collect())
    want = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        same = [p[0] for p in PAGES if (p[2] or "").encode() == data and p[0] is not None]
        revisit = len(data) >= 1000 and i != max(same)
        want.append(((i is None, i or 0), len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None))
    assert got == sorted(want)


def test_warc_files_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    archive.write_archive(pages, str(tmp_path / "store"))
    archive.export_warc(spark, str(tmp_path / "store"), str(tmp_path / "warc"), 3)
    back = sorted((r.header, bytes(r.payload)) for r in archive.read_warc(spark, str(tmp_path / "warc")).collect())
    stored = archive.read_archive(spark, str(tmp_path / "store")).collect()
    want = sorted((r.header, b"" if "WARC-Type: revisit" in r.header else bytes(r.payload)) for r in stored)
    assert back == want
    assert spark.read.parquet(str(tmp_path / "store" / "payloads")).count() == len({p[2] or "" for p in PAGES})
    assert all("Evil" not in h.split("WARC-Target-URI")[0] and "\r\nEvil" not in h for h, _ in back)


def test_a_changed_payload_is_noticed(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    restored = archive.records(pages).withColumn("payload", F.lit("other").cast("binary"))
    with pytest.raises(Exception, match="does not match its header"):
        archive.describe(restored).collect()


def _check_pieces(rows, texts):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer_path())
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, t in texts:
        ids = np.array(tk.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4")
        copies = sum(x[0] == i for x in texts)
        seen = np.zeros(len(ids), int)
        for r in by_doc[i]:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
            seen[r.start : r.start + r.length] += 1
        assert (seen == copies).all()
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 4096
    return by_seq


def test_packing_covers_every_id_once(odd):
    _check_pieces(packing.pack(odd, tokenizer_path()).collect(), [(i, t) for i, t, _, _ in ODD])


def test_packing_of_special_strings_and_marks(spark):
    texts = [(i, t) for i, t in enumerate(["a<|endoftext|>b <|ENDOFTEXT|> it's don't..", "x,.;! ΣΑΣ İstanbul ǅ 'S 'll", "ﬁ ① ½ Ⅷ naïve, ok. end", "a b c é, ́x.", "﻿x ​, --- ...", prose(4, 500)])]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    _check_pieces(packing.pack(docs, tokenizer_path()).collect(), texts)


def test_packing_wastes_little(spark):
    texts = [(i, prose(i, 20 + i * i % 900)) for i in range(600)]
    by_seq = _check_pieces(packing.pack(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), tokenizer_path()).collect(), texts)
    used = [sum(r.length for r in s) for s in by_seq.values()]
    padded = [n if n & (n - 1) == 0 else 4096 for n in used]
    assert sum(used) > 0.97 * sum(padded)
    assert len({r.tier for s in by_seq.values() for r in s}) >= 3
    steps = defaultdict(int)
    for s in by_seq.values():
        steps[s[0].step_id] += sum(r.length for r in s)
    assert max(steps.values()) - min(steps.values()) <= 4096


def test_mix_meets_its_targets(spark):
    sources = {"a": 300, "b": 40, "c": 80, None: 25}
    texts, i = [], 0
    for source, n in sources.items():
        for k in range(n):
            texts.append((i, prose(i, 1 + (i * 37) % 120), "en", source))
            i += 1
    docs = spark.createDataFrame(rows_of(texts), COLUMNS)
    rows = mixing.mix(docs).collect()
    size, taken, target = defaultdict(int), defaultdict(int), {}
    names = {i: s for i, _, _, s in texts}
    for r in rows:
        assert r.size == len(texts[r.doc_id][1].split()) and 0 <= r.taken <= 2 * r.size and r.taken == r.repeats * r.size
        size[names[r.doc_id]] += r.size
        taken[names[r.doc_id]] += r.taken
        target[names[r.doc_id]] = r.target
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6
    weights = {"a": 3, "b": 1, "c": 2, None: 3}
    free = {s for s in size if target[s] < 2 * size[s]}
    assert all(target[s] <= 2 * size[s] + 1e-9 for s in size)
    assert len({round(target[s] / weights[s], 6) for s in free}) <= 1
    assert all(target[s] / weights[s] <= min(target[f] / weights[f] for f in free) + 1e-6 for s in size)
    assert all(abs(taken[s] - target[s]) <= max(2, 0.01 * target[s]) for s in size)
    assert sorted(map(tuple, mixing.mix(docs.repartition(7)).collect())) == sorted(map(tuple, rows))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {r.doc_id: r.repeats for r in rows if r.repeats}


def test_mix_of_awkward_rows(odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD)
    assert all(r.taken <= 2 * r.size for r in rows)
    assert {r.doc_id for r in rows if r.size == 0} == {1, 2, 3}


def test_water_level_when_all_are_capped_or_empty(spark):
    rows = spark.createDataFrame([("a", 0), ("b", 0)], "source string, source_size long")
    assert [r.target for r in mixing.water_fill(rows).collect()] == [0.0, 0.0]
    rows = spark.createDataFrame([("a", 10), ("b", 10), (None, 1)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.water_fill(rows, share=2.0).collect()}
    assert got == {"a": 20.0, "b": 20.0, None: 2.0}


def test_license_scan_finds_lines_paragraphs_and_texts(spark):
    mit = licenses.TEMPLATES["MIT-text"]
    texts = [
        (1, prose(1, 50) + "\nReleased under the MIT License.\n" + prose(2, 20)),
        (2, mit),
        (3, "intro\n\n" + mit.replace("\n", " \n  ").upper() + "\n\nmore " + prose(5, 300)),
        (4, "under the license of the software, without warranty"),
        (5, None),
        (6, "LICENSED under  the *Apache* license; version 2.0!"),
        (7, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License."),
        (8, ""),
    ]
    got = {r.doc_id: (r.n_matches, r.licenses, r.best_license) for r in licenses.license_scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[1] == (1, "MIT", "MIT") and got[2] == (1, "MIT-text", "MIT-text") and got[3] == (1, "MIT-text", "MIT-text")
    assert got[4] == got[5] == got[8] == (0, "", None)
    assert got[6] == (1, "Apache-2.0", "Apache-2.0") and got[7] == (3, "CC-BY-NC-4.0,MIT", "CC-BY-NC-4.0")


def test_license_scan_finds_notices_laid_out_in_paragraphs(spark):
    import textwrap

    cuts = {
        "MIT-text": ["The above", "THE SOFTWARE IS"],
        "ISC": ["THE SOFTWARE IS"],
        "GPL-2.0-header": ["This program is dist", "You should"],
        "GPL-3.0-header": ["This program is dist", "You should"],
        "AGPL-3.0-header": ["This program is dist", "You should"],
        "LGPL-2.1-header": ["This library is dist", "You should"],
        "LGPL-3.0-header": ["This program is dist", "You should"],
        "Apache-2.0-header": ["http:", "Unless"],
        "BSD-2-Clause-text": ["1. Re", "2. Re", "THIS SOFTWARE"],
        "BSD-3-Clause-text": ["1. Re", "2. Re", "3. Nei", "THIS SOFTWARE"],
    }
    texts, names = [], list(cuts)
    for i, (name, starts) in enumerate(cuts.items()):
        whole = " ".join(licenses.TEMPLATES[name].split())
        at = [0, *(whole.index(x) for x in starts), len(whole)]
        notice = "\n\n".join(textwrap.fill(whole[a:b], 78) for a, b in zip(at, at[1:]))
        texts.append((i, prose(i, 400) + "\n\n" + notice + "\n\n" + prose(50 + i, 400)))
    texts.append((len(names), prose(8, 300) + "\n\n" + " ".join(licenses.TEMPLATES["LGPL-3.0"].split()) + "\n\n" + prose(9, 300)))
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    found = [set(got[i].licenses.split(",")) for i in range(len(texts))]
    own = {"MIT-text": "MIT-text-", "ISC": "ISC-", "BSD-2-Clause-text": "BSD-"}
    for i, name in enumerate(names):
        assert any(x.startswith(own.get(name, name.replace("-text", ""))) for x in found[i]), name
    assert "BSD-disclaimer" in found[8] & found[9]
    assert any(x.startswith("BSD-3") for x in found[9]) and not any(x.startswith("BSD-3") for x in found[8])
    assert found[names.index("GPL-3.0-header")] == {"GPL-3.0-header-1", "GPL-header-2", "GPL-3.0-header-3"}
    assert found[-1] == {"LGPL-3.0"}


def test_cues_and_bounds_lose_no_match():
    cues = set(licenses.cue_words())
    for text in licenses.TEMPLATES.values():
        grams = licenses.bigrams_of(text)
        low, high = licenses.size_bounds(len(grams))
        without = [g for g in grams if not cues & set(g.split())]
        # A unit without any cue shares at most these, and scores most if it has nothing else.
        assert 2 * len(without) / (len(grams) + len(without)) < licenses.LEAST
        for n in range(1, 4 * len(grams)):
            assert low <= n <= high or 2 * min(n, len(grams)) / (n + len(grams)) < licenses.LEAST


def test_license_scan_of_awkward_rows(odd):
    rows = licenses.license_scan(odd).collect()
    assert len(rows) == len({i for i, *_ in ODD}) and all(r.n_matches == 0 for r in rows)

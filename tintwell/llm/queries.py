"""Registered queries of the operators, each with its SQL where SQL can state it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tintwell.llm import archive, crf_secrets, exact_dedup, hmm, language, licenses, minhash, mixing, near_vectors, packing, periodic, square_packing, term_scan
from tintwell.llm.common import table
from tintwell.plans.registry import query

TOKENIZER_FILE = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER_FILE)


@query(
    "op1_robust_graph_links",
    """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND list_sum(list_transform(e, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END)) = 0
  AND list_sum(list_transform(e, lambda x: CASE WHEN x <> 0 THEN 1 ELSE 0 END)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT a AS node, b AS other FROM l UNION SELECT r.node, l.b FROM reach r JOIN l ON l.a = r.other),
c AS (SELECT node, min(other) AS low FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, coalesce(least(c.low, v.vec_id), v.vec_id) AS component_id, coalesce(least(c.low, v.vec_id), v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN c ON c.node = v.vec_id""",
)
def op1_robust_graph_links(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, folder, "embeddings"))


@query("op2_license_scan", licenses.oracle_sql())
def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_scan(table(spark, folder, "documents"))


@query("op3_tiered_packing")
def op3_tiered_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer_path())


@query(
    "op4_content_archive",
    """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
q AS (SELECT page_id, octet_length(encode(body)) AS n, sha1(body) AS digest FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS first_id FROM q)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> first_id THEN first_id END AS refers_to
FROM r""",
)
def op4_content_archive(spark: SparkSession, folder: str) -> DataFrame:
    return archive.archived_pages(table(spark, folder, "pages"))


@query(
    "op5_heavy_hitter_dedup",
    """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
e AS (SELECT doc_id, length(t) AS n, sha256(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM d),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM e)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
)
def op5_heavy_hitter_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, folder, "documents"))


@query("op6_field_secrets")
def op6_field_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return crf_secrets.digests(crf_secrets.secret_spans(table(spark, folder, "documents")))


@query("op7_output_code_language")
def op7_output_code_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


@query(
    "op8_tensored_minhash",
    """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
      ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS sh FROM w) t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT i.a, i.b FROM i JOIN n na ON na.doc_id = i.a JOIN n nb ON nb.doc_id = i.b WHERE 100 * common >= 85 * (na.n + nb.n - common)),
ends AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT a AS node, b AS other FROM ends UNION SELECT r.node, x.b FROM reach r JOIN ends x ON x.a = r.other),
c AS (SELECT node, min(other) AS low FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least(c.low, d.doc_id), d.doc_id) AS component_id, coalesce(least(c.low, d.doc_id), d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id""",
)
def op8_tensored_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_classes(table(spark, folder, "documents"))


@query("op9_hidden_markov_scores")
def op9_hidden_markov_scores(spark: SparkSession, folder: str) -> DataFrame:
    return hmm.score_documents(table(spark, folder, "documents"))


@query(
    "op10_water_filling_mix",
    """
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS draw FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
k AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 2 * source_size AS cap FROM s),
total AS (SELECT sum(source_size) * 1.5::DOUBLE AS goal FROM s),
-- Each round closes the sources that the common level would fill beyond their cap.
fill AS (
  SELECT 0 AS round, (SELECT goal FROM total) / (SELECT sum(weight) FROM k) AS level
  UNION ALL
  SELECT round + 1, next FROM (
    SELECT f.round, f.level, ((SELECT goal FROM total) - (SELECT CAST(coalesce(sum(cap), 0) AS DOUBLE) FROM k WHERE cap / weight <= f.level)) / (SELECT sum(weight) FROM k WHERE cap / weight > f.level) AS next
    FROM fill f) t
  WHERE next > level),
lev AS (SELECT max(level) AS level FROM fill),
g AS (SELECT source, source_size, CASE WHEN cap / weight <= level THEN CAST(cap AS DOUBLE) ELSE weight * level END AS target FROM k, lev),
h AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM g),
p AS (SELECT *, target - whole * source_size AS part FROM h),
r AS (SELECT d.*, p.source_size, p.target, p.whole, p.part, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw) AS upto FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
e AS (SELECT *, part - coalesce(max(CASE WHEN upto <= part THEN upto END) OVER (PARTITION BY source), 0) AS rest FROM r),
x AS (SELECT source, arg_min(draw, (abs(size - rest), draw)) AS extra FROM e WHERE upto > part AND abs(size - rest) < rest GROUP BY source)
SELECT e.doc_id, e.size, e.source_size, e.target, CAST(e.size * (e.whole + CASE WHEN e.upto <= e.part OR e.draw = x.extra THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM e LEFT JOIN x ON e.source IS NOT DISTINCT FROM x.source""",
)
def op10_water_filling_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query(
    "op11_periodic_runs",
    """
WITH c AS (
  SELECT doc_id, coalesce(text, '') AS t, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)))) AS h
  FROM documents),
s AS (SELECT doc_id, h, h // 10 AS g, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM c),
a AS (SELECT *, len(words) AS n, CASE WHEN h % 10 = 0 AND len(words) > 0 THEN g % len(words) END AS a FROM s),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
d AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN words ELSE list_transform(range(0, n), lambda i: words[(CASE WHEN i < a THEN i ELSE a + (i - a) % p END) + 1]) END AS words FROM p),
w AS (SELECT doc_id, n, unnest(range(0, n)) AS i, unnest(words) AS word FROM d),
-- Equal words q apart, in stretches without a break.
e AS (SELECT x.doc_id, y.i - x.i AS q, x.i AS i FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i AND 3 * (y.i - x.i) <= x.n),
k AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS stretch FROM e),
m AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS n FROM k GROUP BY doc_id, q, stretch HAVING count(*) + q >= greatest(24, 3 * q)),
r AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m z WHERE z.doc_id = m.doc_id AND z.q < m.q AND z.s <= m.s AND z.s + z.n >= m.s + m.n)),
l AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM r GROUP BY doc_id),
b AS (
  SELECT r.* FROM r WHERE NOT EXISTS (SELECT 1 FROM r z WHERE z.doc_id = r.doc_id AND (z.n * r.q > r.n * z.q OR z.n * r.q = r.n * z.q AND (z.s < r.s OR z.s = r.s AND z.q < r.q)))),
x AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + n)) AS i FROM r),
o AS (SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) AS kept FROM w LEFT JOIN x ON x.doc_id = w.doc_id AND x.i = w.i WHERE x.i IS NULL GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(l.n_runs, 0) AS n_runs, b.s AS start, CAST(b.n AS BIGINT) AS length, b.q AS period, CAST(1000 * b.n // b.q AS BIGINT) AS exponent_milli,
  sha256(coalesce(l.lines, '')) AS runs_sha256, sha256(coalesce(o.kept, '')) AS collapsed_sha256
FROM d LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN o ON o.doc_id = d.doc_id""",
)
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic.run_digests(periodic.periodic_runs(periodic.with_planted_periods(table(spark, folder, "documents"))))


@query(
    "op12_term_scan",
    """
WITH t AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
d AS (SELECT doc_id, len(terms) AS n, terms FROM t WHERE len(terms) > 0),
g AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS words FROM d),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, CAST(count(*) AS BIGINT) AS times FROM i GROUP BY ALL),
f AS (SELECT doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM d) u WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM f GROUP BY term) x, g),
s AS (
  SELECT q.item_id, f.doc_id, CAST(sum(q.times * w.w * ((1000000000 * f.tf) // (1000 * f.tf + 12 * (75 + (25 * f.n * g.docs) // g.words)))) AS BIGINT) AS score
  FROM q JOIN f ON f.term = q.term JOIN w ON w.term = q.term, g GROUP BY q.item_id, f.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 20""",
)
def op12_term_scan(spark: SparkSession, folder: str) -> DataFrame:
    return term_scan.ranked_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op13_square_packing")
def op13_square_packing(spark: SparkSession, folder: str) -> DataFrame:
    return square_packing.square_pack(table(spark, folder, "documents"), tokenizer_path())

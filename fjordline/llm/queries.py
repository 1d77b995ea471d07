"""The registered corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import importance, language, mixing, near_vectors, pieces, pii, prefix_trie, quality_rules, secrets, simhash, toxicity, url_filter, warc
from .work import read

URL_RULES = [
    url_filter.UrlRule("org/", "allow"),
    url_filter.UrlRule("example.org/es/", "block"),
    url_filter.UrlRule("example.org/en/1", "block"),
    url_filter.UrlRule("com/fr/", "allow"),
    url_filter.UrlRule("com/de/", "block"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block list holds the keys (host + path) of urls seen with a campaign parameter."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, URL_RULES, F.col("url").contains("utm_source="))


OP1_SQL = """
WITH r AS (SELECT page_id, url, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN NULL ELSE substr(url, position('://' IN url) + 3) END AS rest FROM pages),
h AS (SELECT page_id, url,
  coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM r),
l AS (SELECT DISTINCT host || path AS k FROM h WHERE host <> '' AND contains(url, 'utm_source=')),
f AS (SELECT page_id, url, host, path, (host || path) IN (SELECT k FROM l) AS listed,
  CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
       WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
       WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
       WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
       WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM h)
SELECT page_id, url, host, path, listed, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN listed THEN 'block' ELSE 'allow' END AS verdict FROM f
"""


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(read(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ok AS (SELECT * FROM e WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept FROM e JOIN c ON e.vec_id = c.a LEFT JOIN n ON e.vec_id = n.a
"""


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(read(spark, sf_dir, "pages"))


OP3_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS newest FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(h, CAST(floor(i / 4) AS INTEGER) * 5 + 1, 5) AS INTEGER) // CAST(pow(32, 3 - i % 4) AS INTEGER)) % 32 + 1 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> newest THEN newest END AS refers_to FROM m
"""


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, c -> c.kind = {i})) AS bigint)").alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(F.expr(pii.joined("base")), 256).alias("base_sha256"), F.expr(pii.joined("spans")).alias("spans"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "source"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    counts = [F.col(f"st.{k}").alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *counts, "base_failed", "kept")


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language.identify(docs, language.learn(docs))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(read(spark, sf_dir, "conversations"))


def _crc32(raw: str) -> str:
    """crc32 of a blob in DuckDB: each byte is followed by eight markers, one for each bit to be shifted out."""
    steps = f"flatten(list_transform(range(0, octet_length({raw})), lambda i: [CAST('0x' || substr(hex({raw}), 2 * i + 1, 2) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {steps}), lambda c, x: {step}), 4294967295)"


OP12_SQL = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, {{'r': coalesce(role, ''), 't': coalesce("text", '')}} AS x FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT conv_id, encode(CAST(conv_id AS VARCHAR)) AS raw FROM t GROUP BY 1), h AS (SELECT conv_id, {_crc32("raw")} % 4 AS h FROM i),
r AS (SELECT h.conv_id, 0 AS part, b.pos, b.x FROM h JOIN t b ON b.conv_id = h.conv_id - h.conv_id % 20 AND b.pos <= h.h UNION ALL SELECT h.conv_id, 1, t.pos, t.x FROM h JOIN t ON t.conv_id = h.conv_id AND t.pos > h.h),
l AS (SELECT h.conv_id, coalesce(list(r.x ORDER BY r.part, r.pos) FILTER (r.x IS NOT NULL), []) AS s FROM h LEFT JOIN r ON r.conv_id = h.conv_id GROUP BY 1),
p AS (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS depth FROM l), q AS (SELECT conv_id, depth, list_slice(s, 1, depth) AS k, len(s) = depth AS ended FROM p),
n AS (SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256 FROM q GROUP BY 1, 2),
c AS (SELECT list_slice(k, 1, depth - 1) AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
v AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children, (n_convs - 1) * CASE WHEN n.depth = 0 THEN 0 ELSE len(regexp_extract_all(n.k[n.depth].t, '[^\x20\x09-\x0D]+')) END AS saved FROM n LEFT JOIN c ON c.k = n.k),
a AS (SELECT k, unnest(range(0, depth + 1)) AS d, CAST(n_children = 0 AS BIGINT) AS leaf, saved FROM v), s AS (SELECT list_slice(k, 1, d) AS k, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM a GROUP BY 1)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
FROM v JOIN s ON s.k = v.k LEFT JOIN n u ON v.depth > 0 AND u.k = list_slice(v.k, 1, v.depth - 1)
"""


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP13_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS f FROM documents),
e AS (SELECT regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS f FROM benchmark),
x AS (SELECT doc_id, unnest(f) AS w FROM d), y AS (SELECT unnest(f) AS w FROM e), u AS (SELECT w, encode(w) AS raw FROM (SELECT w FROM x UNION SELECT w FROM y)),
b AS (SELECT w, {_crc32("raw")} % 10000 AS bucket FROM u), s AS (SELECT bucket, count(*) AS s FROM x JOIN b USING (w) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM y JOIN b USING (w) GROUP BY 1),
g AS (SELECT b.w, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM x) + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM y) + 10000)))) AS BIGINT) AS gain FROM b LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
m AS (SELECT doc_id, count(*) AS n, sum(gain) AS total FROM x JOIN g USING (w) GROUP BY 1),
z AS (SELECT d.doc_id, CAST(len(f) AS BIGINT) AS n_features, coalesce(CAST((total - ((total % n) + n) % n) // n AS BIGINT), 0) AS weight, CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN m USING (doc_id)),
k AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM z),
o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS fit FROM k)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * fit // 100 THEN place END AS rank FROM o
"""


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts that the quality rules rest on, which SQL can express."""
    judged = quality_rules.judge(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", *(F.col(f"st.{k}").alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "base_failed")


COUNTS_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM h, range(0, 3) x(k) WHERE n > 1 GROUP BY doc_id),
s AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s
"""


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_near_vectors": op2_near_vectors,
    "op3_warc": op3_warc,
    "op4_pieces": op4_pieces,
    "op5_secrets": op5_secrets,
    "op6_pii": op6_pii,
    "op7_mixing": op7_mixing,
    "op8_toxicity": op8_toxicity,
    "op9_simhash": op9_simhash,
    "op10_quality_rules": op10_quality_rules,
    "op11_language": op11_language,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_importance": op13_importance,
    "quality_counts": quality_counts,
}
ORACLES: dict[str, str] = {"op1_url_filter": OP1_SQL, "op2_near_vectors": OP2_SQL, "op3_warc": OP3_SQL, "op12_prefix_trie": OP12_SQL, "op13_importance": OP13_SQL, "quality_counts": COUNTS_SQL}

"""The registered query of each text operator: its whole table, production parameters, full result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from callmeter.llm import collocations, decontaminate, exact_dedup, fingerprint, licenses, lm_score, minhash, packing, prefix_trie, substring_dedup, suffix_dedup, surrogates, toxicity
from callmeter.llm.text import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(documents(spark, sf_dir))


@_query
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_query
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_bytes(documents(spark, sf_dir))


# Every 50-byte string with the smallest document it starts in; places seen before, joined to runs; what lies between the runs stays.
ORACLE["op3_suffix_dedup"] = """
WITH raw AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
starts AS (SELECT doc_id, b, unnest(generate_series(1, octet_length(b) - 49)) AS i FROM raw),
strings AS (SELECT doc_id, i, b[i:i + 49] AS g FROM starts),
lowest AS (SELECT g, min(doc_id) AS low FROM strings GROUP BY 1),
seen AS (SELECT doc_id, i FROM strings JOIN lowest USING (g) WHERE low < doc_id),
marked AS (SELECT *, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 50, true) AS fresh FROM seen),
numbered AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
runs AS (SELECT doc_id, run, min(i) AS a, max(i) + 49 AS z FROM numbered GROUP BY 1, 2),
edges AS (SELECT doc_id, a, z FROM runs UNION ALL SELECT doc_id, octet_length(b) + 1, NULL FROM raw),
kept AS (SELECT doc_id, a, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a, z) + 1, 1) AS since FROM edges),
left_over AS (SELECT doc_id, string_agg(hex(b[since:a - 1]), '' ORDER BY a) AS h FROM kept JOIN raw USING (doc_id) WHERE since < a GROUP BY 1),
sums AS (SELECT doc_id, sum(z - a + 1)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY 1)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(h, ''))) AS kept_sha256
FROM raw LEFT JOIN sums USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""


@_query
def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(documents(spark, sf_dir))


@_query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


# Exact shingle sets, equal sets folded into one; shared shingles counted per pair; components by their closure.
ORACLE["op6_minhash_near_dedup"] = r"""
WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_sort(list_distinct(list_transform(generate_series(1, greatest(len(w) - 4, least(len(w), 1))), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s FROM worded),
folded AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
held AS (SELECT rep, n, unnest(s) AS shingle FROM folded),
pairs AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared FROM held a JOIN held b ON a.shingle = b.shingle AND a.rep < b.rep GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * shared >= 75 * (na + nb - shared)),
steps AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT rep AS a, rep AS b FROM folded UNION SELECT r.a, s.b FROM reach r JOIN steps s ON r.b = s.a),
lowest AS (SELECT a AS rep, min(b) AS component FROM reach GROUP BY 1)
SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
FROM sets LEFT JOIN folded ON folded.s = sets.s LEFT JOIN lowest USING (rep)
"""


@_query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.severity(docs, toxicity.fit_severity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@_query
def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scores(documents(spark, sf_dir))


@_query
def op9_private_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replaced(documents(spark, sf_dir)).select("doc_id", "n_private", "text")


@_query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_words(documents(spark, sf_dir))


# Every window of 13 words with the smallest document it starts in; words under a window seen before go.
ORACLE["op10_substring_dedup"] = r"""
WITH worded AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM worded),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM starts),
lowest AS (SELECT g, min(doc_id) AS low FROM windows GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM windows JOIN lowest USING (g), (SELECT unnest(generate_series(0, 12)) AS k) WHERE low < doc_id),
places AS (SELECT doc_id, unnest(generate_series(1, len(w))) AS i, unnest(w) AS word FROM worded),
left_over AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM places ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM worded LEFT JOIN left_over USING (doc_id)
"""


@_query
def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


ORACLE["op12_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
WINDOW same AS (PARTITION BY norm)
"""


@_query
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.shared_prefixes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


# crc32 by its byte table; then each prefix of a rebuilt conversation as a list of digests, and subtrees by comparing lists.
ORACLE["op13_conversation_trie"] = """
WITH RECURSIVE steps AS (
  SELECT range AS byte, range AS v, 0 AS k FROM range(256)
  UNION ALL SELECT byte, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (
  SELECT conv_id, conv_id::VARCHAR AS rest, 4294967295::BIGINT AS c FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)
  UNION ALL SELECT conv_id, rest[2:], xor(c >> 8, v) FROM crc JOIN steps ON k = 8 AND byte = xor(c, ascii(rest[1])) & 255 WHERE rest <> ''),
heads AS (SELECT conv_id, (xor(c, 4294967295) % 9)::BIGINT AS h FROM crc WHERE rest = ''),
turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
coded AS (SELECT conv_id, turn, strlen(text) AS size, sha256(strlen(role)::VARCHAR || ':' || role || text)[1:32] AS digest FROM turns),
own AS (SELECT conv_id, list({'d': digest, 'n': size} ORDER BY turn NULLS FIRST, digest, size) AS t FROM coded GROUP BY conv_id),
rebuilt AS (SELECT o.conv_id, list_concat(coalesce(b.t[1:h], []), o.t[h + 1:]) AS p
  FROM own o JOIN heads USING (conv_id) LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5),
places AS (SELECT conv_id, len(p) AS whole, unnest(generate_series(0, len(p))) AS depth, p FROM rebuilt),
nodes AS (SELECT depth, list_transform(p[1:depth], lambda x: x.d) AS path, max(p[depth].n) AS size, min(conv_id) AS conv_id, count(*) AS n_convs,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (whole = depth), '')) AS ends_sha256 FROM places GROUP BY 1, 2),
kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
counted AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (path)),
sums AS (SELECT d.path[1:u.depth] AS path, count(*) FILTER (d.n_children = 0) AS n_leaves, sum((d.n_convs - 1) * coalesce(d.size, 0))::BIGINT AS saved_tokens
  FROM counted d, unnest(generate_series(0, d.depth)) AS u(depth) GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
FROM counted n JOIN sums USING (path) LEFT JOIN counted p ON n.depth > 0 AND p.path = n.path[1:n.depth - 1]
"""


@_query
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


ORACLE["op11_phrase_collocations"] = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::HUGEINT AS total FROM worded GROUP BY 1),
placed AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM worded),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM placed, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, phrase, k, count(*)::HUGEINT AS n FROM grams GROUP BY 1, 2, 3),
candidates AS (SELECT * FROM f WHERE k > 1 AND n >= 100),
cuts AS (SELECT *, unnest(generate_series(1, k - 1)) AS j FROM candidates),
parts AS (SELECT lang, phrase, k, n, j, array_to_string(string_split(phrase, ' ')[1:j], ' ') AS head, array_to_string(string_split(phrase, ' ')[j + 1:], ' ') AS tail FROM cuts),
scored AS (SELECT p.lang, p.phrase, p.k, p.n AS a, a.n AS l, b.n AS r, total, (1000 * p.n * total) // (a.n * b.n) AS score, j
  FROM parts p JOIN f a ON a.lang = p.lang AND a.phrase = head JOIN f b ON b.lang = p.lang AND b.phrase = tail JOIN totals t ON t.lang = p.lang),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
kept AS (SELECT * FROM worst c WHERE NOT EXISTS (SELECT 1 FROM candidates q WHERE q.lang = c.lang AND q.k > c.k AND 100 * q.n >= 100 * c.a
  AND contains(' ' || q.phrase || ' ', ' ' || c.phrase || ' ')))
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, total::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000
"""

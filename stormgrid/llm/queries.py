"""The numbered operators over the driver's tables, with their production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .decontaminate import leaks
from .language import language
from .licenses import license_scan
from .line_dedup import drop_boilerplate
from .near_join import near_links
from .packing import pack
from .quality import quality
from .search import search
from .sharding import shard_documents
from .spelling import spelling_variants
from .substring_dedup import substring_dedup
from .toxicity import toxicity
from .vector_codes import vector_codes


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(documents(spark, sf_dir)).select("doc_id", "source", "n_lines", "n_dropped", "text")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_links(documents(spark, sf_dir))


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir)
    return search(rows, rows.where(F.col("doc_id") % 20 == 0))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language(documents(spark, sf_dir))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(documents(spark, sf_dir, "embeddings"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_license_scan, op2_decontamination, op3_line_dedup, op4_best_fit_packing, op5_toxicity, op6_ngram_jaccard_join, op7_topk_search, op8_substring_dedup, op9_language_id, op10_sharding, op11_vector_codes, op12_quality_rules, op13_spelling_variants)
}

ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": """
WITH lines AS (
  SELECT d.doc_id, coalesce(d.source, '') AS site, i AS at, string_split(d.text, chr(10))[i] AS line
  FROM documents d, range(1, len(string_split(d.text, chr(10))) + 1) r(i)
),
total AS (SELECT coalesce(source, '') AS site, count(*) AS total FROM documents GROUP BY 1),
held AS (SELECT site, trim(line, ' ') AS line, count(DISTINCT doc_id) AS pages FROM lines WHERE trim(line, ' ') <> '' GROUP BY 1, 2),
bad AS (SELECT site, line FROM held JOIN total USING (site) WHERE pages >= 3 AND pages > 0.02 * total),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(b.line) AS n_dropped,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.at) FILTER (WHERE b.line IS NULL), '') AS text
  FROM lines l LEFT JOIN bad b ON b.site = l.site AND b.line = trim(l.line, ' ') GROUP BY l.doc_id
)
SELECT d.doc_id, d.source, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped,
       CASE WHEN d.text IS NOT NULL THEN k.text END AS text
FROM documents d LEFT JOIN kept k USING (doc_id)
""",
    "op8_substring_dedup": r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM words, range(1, greatest(len(w) - 48, 1)) r(i) WHERE len(w) >= 50
),
firsts AS (SELECT h, min(doc_id) AS low FROM windows GROUP BY h),
gone AS (
  SELECT DISTINCT doc_id, j FROM (
    SELECT doc_id, i FROM windows JOIN firsts USING (h) WHERE doc_id > low
  ), range(0, 50) s(o), (SELECT 0) z, LATERAL (SELECT i + o AS j)
),
kept AS (
  SELECT w.doc_id, count(*) AS n, count(g.j) AS n_removed,
         coalesce(string_agg(w.w[p], ' ' ORDER BY p) FILTER (WHERE g.j IS NULL), '') AS text
  FROM words w CROSS JOIN range(1, len(w.w) + 1) r(p) LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.j = p GROUP BY w.doc_id
)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM words w LEFT JOIN kept k USING (doc_id)
""",
    "op11_vector_codes": """
WITH kept AS (
  SELECT vec_id, label, embedding AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
c AS (
  SELECT vec_id, i // (len(e) // 16) AS p, i % (len(e) // 16) AS i, CAST(floor(256 * CAST(e[i + 1] AS DOUBLE)) AS BIGINT) AS v FROM kept, range(0, len(e)) r(i)
),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM kept QUALIFY k < 64),
e0 AS (SELECT k, p, i, v FROM c JOIN first USING (vec_id)),
q0 AS (
  SELECT vec_id, p, min(d * 64 + k) AS q FROM (SELECT c.vec_id, c.p, e.k, CAST(sum((c.v - e.v) * (c.v - e.v)) AS BIGINT) AS d FROM c JOIN e0 e USING (p, i) GROUP BY ALL) GROUP BY ALL
),
m0 AS (SELECT p, q % 64 AS k, i, CAST(floor(sum(v) / count(*)) AS BIGINT) AS v FROM c JOIN q0 USING (vec_id, p) GROUP BY ALL),
e1 AS (SELECT e.k, e.p, e.i, coalesce(m.v, e.v) AS v FROM e0 e LEFT JOIN m0 m USING (p, k, i)),
q1 AS (
  SELECT vec_id, p, min(d * 64 + k) AS q FROM (SELECT c.vec_id, c.p, e.k, CAST(sum((c.v - e.v) * (c.v - e.v)) AS BIGINT) AS d FROM c JOIN e1 e USING (p, i) GROUP BY ALL) GROUP BY ALL
),
m1 AS (SELECT p, q % 64 AS k, i, CAST(floor(sum(v) / count(*)) AS BIGINT) AS v FROM c JOIN q1 USING (vec_id, p) GROUP BY ALL),
e2 AS (SELECT e.k, e.p, e.i, coalesce(m.v, e.v) AS v FROM e1 e LEFT JOIN m1 m USING (p, k, i)),
q2 AS (
  SELECT vec_id, p, min(d * 64 + k) AS q FROM (SELECT c.vec_id, c.p, e.k, CAST(sum((c.v - e.v) * (c.v - e.v)) AS BIGINT) AS d FROM c JOIN e2 e USING (p, i) GROUP BY ALL) GROUP BY ALL
),
coded AS (SELECT vec_id, string_agg(printf('%02x', q % 64), '' ORDER BY p) AS code, CAST(sum(q // 64) AS BIGINT) AS error FROM q2 GROUP BY 1)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, k, i)) FROM e2) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
""",
    "op12_quality_rules": r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
),
words AS (SELECT doc_id, i, length(w[i]) AS c FROM t, range(1, len(w) + 1) r(i)),
base AS (SELECT doc_id, count(*) AS n_words, CAST(sum(c) AS BIGINT) AS word_chars FROM words GROUP BY 1),
grams AS (
  SELECT doc_id, n, i, md5(array_to_string(w[i:i + n - 1], ' ')) AS h FROM t, (SELECT unnest([2, 3, 4, 5, 7, 10]) AS n) z, range(1, greatest(len(w) - n + 2, 1)) r(i) WHERE len(w) >= n
),
twice AS (SELECT doc_id, n, h FROM grams GROUP BY ALL HAVING count(*) > 1),
inside AS (SELECT DISTINCT doc_id, n, i + o AS i FROM grams JOIN twice USING (doc_id, n, h), range(0, 10) s(o) WHERE o < n),
cover AS (SELECT doc_id, n, count(*) AS words, CAST(sum(c) AS BIGINT) AS chars FROM inside JOIN words USING (doc_id, i) GROUP BY 1, 2),
wide AS (
  SELECT doc_id, coalesce(max(words) FILTER (n = 5), 0) AS n_repeat_words,
         coalesce(max(chars) FILTER (n = 2), 0) AS chars_2, coalesce(max(chars) FILTER (n = 3), 0) AS chars_3, coalesce(max(chars) FILTER (n = 4), 0) AS chars_4,
         coalesce(max(chars) FILTER (n = 5), 0) AS chars_5, coalesce(max(chars) FILTER (n = 7), 0) AS chars_7, coalesce(max(chars) FILTER (n = 10), 0) AS chars_10
  FROM t LEFT JOIN cover USING (doc_id) GROUP BY doc_id
),
lines AS (SELECT doc_id, i, string_split(t, chr(10))[i] AS line FROM t, range(1, len(string_split(t, chr(10))) + 1) r(i)),
again AS (
  SELECT doc_id, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS c FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1
),
dup AS (SELECT doc_id, count(*) AS n_dup_lines, CAST(sum(c) AS BIGINT) AS dup_line_chars FROM again GROUP BY 1),
found AS (
  SELECT t.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, n_repeat_words, coalesce(dup_line_chars, 0) AS dup_line_chars, chars_2, chars_3, chars_4, chars_5, chars_7, chars_10
  FROM t LEFT JOIN base USING (doc_id) LEFT JOIN dup USING (doc_id) JOIN wide USING (doc_id)
),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM found)
SELECT *, NOT base_failed AND 100 * dup_line_chars <= 30 * word_chars AND 100 * n_symbols <= 20 * n_words
       AND 100 * chars_2 <= 60 * word_chars AND 100 * chars_3 <= 55 * word_chars AND 100 * chars_4 <= 50 * word_chars
       AND 100 * chars_5 <= 25 * word_chars AND 100 * chars_7 <= 25 * word_chars AND 100 * chars_10 <= 25 * word_chars AS kept
FROM judged
""",
    "op13_spelling_variants": """
WITH RECURSIVE polynomial AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t FROM range(256) r(b)
),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents
),
by_document AS (SELECT doc_id, r, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (
  SELECT r, n, flatten(list_transform(string_split(doc_id || ':' || r, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(195 AS BIGINT), unicode(c) - 64] END)) AS b FROM by_document
),
hashed AS (SELECT r, n, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM bytes, polynomial),
lost AS (SELECT CASE WHEN h % 97 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM lost WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
gaps AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, range(1, length(word) + 1) r(i)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM gaps a JOIN words b ON b.word = a.rest
  UNION SELECT b.word, a.word, a.n FROM gaps a JOIN words b ON b.word = a.rest
),
best AS (SELECT word, count(*) AS n_near, max(n) AS form_n, arg_min(other, struct_pack(n := -n, other := other)) AS form FROM near GROUP BY 1),
forms AS (
  SELECT word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * words.n THEN form END AS form, CASE WHEN form_n >= 2 * words.n THEN form_n END AS form_n
  FROM words LEFT JOIN best USING (word)
),
steps AS (
  SELECT word, word AS here, 0 AS k FROM words
  UNION ALL SELECT steps.word, form, k + 1 FROM steps JOIN forms ON forms.word = steps.here WHERE form IS NOT NULL
),
roots AS (SELECT word, arg_max(here, k) AS root FROM steps GROUP BY 1)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
""",
}

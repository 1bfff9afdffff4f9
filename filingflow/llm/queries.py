"""The registered queries of the corpus operators, with production parameters, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from . import alignment, decontaminate, divergence, jaccard, langid, lines, lm, mixing, quality, sharding, suffix, tokencount, warc
from .common import read


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.remove_repeats(read(spark, sf_dir, "documents", "doc_id", "text"), texts=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(read(spark, sf_dir, "documents", "doc_id", "text"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(read(spark, sf_dir, "documents", "doc_id", "lang", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "log10_ppl")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive_pages(read(spark, sf_dir, "pages", "page_id", "url", "html"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedupe_lines(read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "n_repeated", "kept_sha256")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(read(spark, sf_dir, "documents", "doc_id", "text"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_layout(read(spark, sf_dir, "documents", "doc_id", "text"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.mark(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents", "text", "lang", "source"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align(read(spark, sf_dir, "documents", "doc_id", "text"), a, b)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(read(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    q.__name__: _shipped(q)
    for q in (
        op1_suffix_array_dedup, op2_ngram_jaccard_join, op3_quality_rules, op4_mixing, op5_language_id,
        op6_warc, op7_substring_dedup, op8_lm_scoring, op9_sharding, op10_decontamination,
        op11_source_divergence, op12_tokenizer_alignment, op13_token_counts,
    )
}

#: Words of op 2 in lower case; then sets of shingles, pairs by their shared shingles, and reachability.
_JACCARD = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN 's' || CAST(len(ws) AS VARCHAR) || array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 4], ' ') END AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)
), r AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.seen
)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.seen) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.node = d.doc_id GROUP BY d.doc_id
"""

#: Base32 of a SHA-1: each five hexadecimal digits make four letters.
_WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p),
d AS (
  SELECT *, array_to_string(list_transform(range(8), lambda k: list_reduce(list_transform([15, 10, 5, 0], lambda b:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST(5 * k + 1 AS INTEGER), 5) AS BIGINT) >> b) % 32 + 1 AS INTEGER), 1)), lambda x, y: x || y)), '') AS digest FROM f
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""

#: Units of op 7 as pieces that make up the whole text; runs are found by numbers that grow together.
_LINES = r"""
WITH p AS (
  SELECT doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^.!?\n]*[.!?\n]+|[^.!?\n]+') AS ps FROM documents)
), w AS (
  SELECT *, regexp_extract_all(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM p
), g AS (
  SELECT *, sum(CAST(len(ws) >= 5 AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM w
), u AS (
  SELECT doc_id, min(i) FILTER (WHERE len(ws) > 0) AS a, max(i) AS z, sum(len(ws)) AS n, string_agg(array_to_string(ws, ' '), ' ' ORDER BY i) FILTER (WHERE len(ws) > 0) AS unit,
         row_number() OVER (PARTITION BY doc_id ORDER BY g) AS k FROM g GROUP BY doc_id, g HAVING sum(len(ws)) > 0
), m AS (
  SELECT *, row_number() OVER (PARTITION BY unit ORDER BY doc_id, k) > 1 AS later, count(*) OVER (PARTITION BY unit) > 1 AS again FROM u
), gone AS (
  SELECT doc_id, min(a) AS a, max(z) AS z FROM (SELECT *, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS g FROM m WHERE later) GROUP BY doc_id, g HAVING sum(n) >= 20
), twice AS (
  SELECT doc_id, min(a) AS a, max(z) AS z FROM (SELECT *, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS g FROM m WHERE again) GROUP BY doc_id, g HAVING sum(n) >= 20
), f AS (
  SELECT p.doc_id, p.piece, p.i, gone.a IS NOT NULL AS gone, twice.a IS NOT NULL AS twice
  FROM p LEFT JOIN gone ON gone.doc_id = p.doc_id AND p.i BETWEEN gone.a AND gone.z LEFT JOIN twice ON twice.doc_id = p.doc_id AND p.i BETWEEN twice.a AND twice.z
), t AS (
  SELECT doc_id, coalesce(string_agg(piece, '' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept, sum(octet_length(encode(piece))) FILTER (WHERE gone) AS removed,
         sum(octet_length(encode(piece))) FILTER (WHERE twice) AS repeated FROM f GROUP BY doc_id
)
SELECT d.doc_id, CAST(octet_length(encode(coalesce(d.text, ''))) AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(s.n, 0) AS BIGINT) AS n_spans, CAST(coalesce(repeated, 0) AS BIGINT) AS n_repeated, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN t USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1) s USING (doc_id)
"""

_CONTAMINATION = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), win AS (
  SELECT DISTINCT item_id, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS s, least(len(ws), 10) AS k
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS i FROM bw WHERE len(ws) > 0)
), met AS (
  SELECT d.doc_id, d.i, win.item_id, d.k
  FROM (SELECT doc_id, i, k, array_to_string(ws[i : i + k - 1], ' ') AS s FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM win))) d
  JOIN win ON win.s = d.s AND win.k = d.k
), hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM met) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM met) GROUP BY 1)
SELECT dw.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: Every pair of groups meets over every kept term of its language.
_DIVERGENCE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents
), w AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
g AS (SELECT d.lang, d.source, any_value(t.total) AS total FROM d LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) t ON t.lang = d.lang AND t.source = d.source GROUP BY d.lang, d.source),
x AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (coalesce(g.total, 0) + 2 * v.v) AS BIGINT) AS p,
         CAST(1 + (1000000000 * (k.n + 2)) // (v.total + 2 * v.v) AS BIGINT) AS q
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), s AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM x a JOIN x b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL
), rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM x WHERE n > 0 AND p > q
)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM rows) WHERE part = 'pair' OR rank <= 10
"""

ORACLES = {
    "op11_source_divergence": _DIVERGENCE,
    "op2_ngram_jaccard_join": _JACCARD,
    "op6_warc": _WARC,
    "op7_substring_dedup": _LINES,
    "op10_decontamination": _CONTAMINATION,
}

"""Each operator over its whole table with production parameters, and SQL where it can tell the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pricewell.llm.common import read
from pricewell.llm.decontaminate import find_items
from pricewell.llm.fill_middle import fill_middle
from pricewell.llm.html_text import extract_text
from pricewell.llm.license_scan import scan_licenses
from pricewell.llm.line_dedup import dedup_lines
from pricewell.llm.quality_classifier import classify
from pricewell.llm.quality_rules import MENU, STOCK_PHRASES, apply_rules
from pricewell.llm.sentencepiece_codec import encode_round_trip
from pricewell.llm.simhash import near_groups
from pricewell.llm.source_divergence import audit_sources
from pricewell.llm.substring_dedup import drop_repeated_windows
from pricewell.llm.suffix_dedup import drop_repeated_strings
from pricewell.llm.warc import archive_round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_line_dedup(spark, sf_dir):
    return dedup_lines(read(spark, sf_dir, "documents"), digest=True)


ORACLES["op1_line_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
lines AS (
  SELECT d.rid, d.doc_id, i.n, list_extract(string_split(coalesce(d.text, ''), chr(10)), i.n) AS line
  FROM d, LATERAL (SELECT unnest(range(1, len(string_split(coalesce(d.text, ''), chr(10))) + 1)) AS n) i),
keyed AS (
  SELECT rid, doc_id, n, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
frequent AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT rid) >= 5),
judged AS (
  SELECT k.rid, k.doc_id, k.n, k.line, f.key IS NOT NULL AND f.last <> k.doc_id AS dropped
  FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY rid, doc_id
"""


@_query
def op4_quality_rules(spark, sf_dir):
    return apply_rules(read(spark, sf_dir, "documents"))


@_query
def op9_simhash(spark, sf_dir):
    return near_groups(read(spark, sf_dir, "documents"))


@_query
def op6_substring_dedup(spark, sf_dir):
    return drop_repeated_windows(read(spark, sf_dir, "documents"), width=20, digest=True)


@_query
def op10_suffix_dedup(spark, sf_dir):
    return drop_repeated_strings(read(spark, sf_dir, "documents"), width=50, digest=True)


@_query
def op2_warc(spark, sf_dir):
    return archive_round_trip(spark, read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query
def op7_license_scan(spark, sf_dir):
    return scan_licenses(read(spark, sf_dir, "documents"))


@_query
def op8_decontamination(spark, sf_dir):
    return find_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@_query
def op3_sentencepiece(spark, sf_dir):
    return encode_round_trip(read(spark, sf_dir, "documents"))


@_query
def op5_quality_classifier(spark, sf_dir):
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


# base32 of a SHA-1: forty hexadecimal digits are eight groups of twenty bits, four letters each
ORACLES["op2_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (
  SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, hex,
    array_to_string(list_transform(range(0, 32), lambda i:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
    min(page_id) OVER (PARTITION BY hex, octet_length(encode(body))) AS first
  FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM d
"""

ORACLES["op6_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, i, array_to_string(ws[i : i + 19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS rn FROM p),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM f WHERE rn > 1),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS j, unnest(ws) AS word FROM w),
left_over AS (
  SELECT words.doc_id, count(*) FILTER (WHERE gone.j IS NOT NULL) AS n_removed,
    string_agg(word, ' ' ORDER BY words.j) FILTER (WHERE gone.j IS NULL) AS kept
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.j = words.j GROUP BY words.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN left_over USING (doc_id)
"""

ORACLES["op4_quality_rules"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, i, array_to_string(ws[i : i + 7], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM p) WHERE c > 1),
repeats AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS j FROM twice) GROUP BY doc_id),
l AS (
  SELECT doc_id, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)),
m AS (
  SELECT doc_id, line, lw, len(lw) AS n, octet_length(encode(array_to_string(lw, ''))) AS bytes, lw[-1] AS last_word,
    len(list_filter(lw, lambda x: x IN ('|', '>', '/', '-', '*', '»', '•', '·'))) AS separators,
    len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols, len(regexp_extract_all(line, '[A-Z]')) AS upper, len(regexp_extract_all(line, '[a-z]')) AS lower,
    len(regexp_extract_all(line, '!!')) AS exclaims
  FROM l),
f AS (
  SELECT *, CASE
    WHEN n = 0 THEN false
    WHEN n >= 5 AND separators > 0.15::DOUBLE * n THEN true
    WHEN symbols > 0.25::DOUBLE * n AND symbols > 1 THEN true
    WHEN n >= 5 AND upper > lower THEN true
    WHEN n >= 5 AND exclaims > 0.25::DOUBLE * n THEN true
    WHEN n >= 5 AND len(list_filter(range(2, n + 1), lambda i: lw[i] = lw[i - 1])) > 0.3::DOUBLE * n THEN true
    WHEN n <= 12 AND regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '""" + "|".join(p.replace("'", "''") for p in STOCK_PHRASES) + r"""') THEN true
    WHEN list_has_all([""" + ", ".join(f"'{w}'" for w in MENU) + r"""], list_transform(lw, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) THEN true
    ELSE n >= 5 AND NOT regexp_matches(line, '[.!?][\x20\x09-\x0D]') AND NOT regexp_matches(last_word, '([.!?;:,"'')\]{}]|…|”|’|»|。|！|？)$') END AS fails
  FROM m),
a AS (
  SELECT doc_id, count(*) FILTER (WHERE n > 0) - count(DISTINCT line) FILTER (WHERE n > 0) AS n_dup_lines,
    sum(bytes) AS total, coalesce(sum(bytes) FILTER (WHERE fails), 0) AS lost
  FROM f GROUP BY doc_id),
b AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    n_dup_lines::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words, lost <= 0.5::DOUBLE * total AS enough
  FROM d JOIN a USING (doc_id) LEFT JOIN repeats USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND enough AS kept
FROM b
"""

_SHINGLES = r"""SELECT {id}, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM (SELECT {id}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM {table})"""
ORACLES["op8_decontamination"] = f"""
WITH i AS ({_SHINGLES.format(id='item_id', table='benchmark')}), d AS ({_SHINGLES.format(id='doc_id', table='documents')}),
ik AS (SELECT item_id, len(s) AS n, unnest(s) AS k FROM i), dk AS (SELECT doc_id, unnest(s) AS k FROM d)
SELECT doc_id, item_id, n::BIGINT AS n_shingles, count(*) / n::DOUBLE AS containment
FROM ik JOIN dk USING (k) GROUP BY doc_id, item_id, n HAVING count(*) / n::DOUBLE >= 0.8
"""


@_query
def op12_fill_middle(spark, sf_dir):
    return fill_middle(read(spark, sf_dir, "documents"), digest=True)


ORACLES["op12_fill_middle"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || doc_id) AS h FROM documents),
g AS (
  SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS c1, ('0x' || h[9:16])::BIGINT % (n + 1) AS c2, ('0x' || h[17:24])::BIGINT % 100 AS r3, ('0x' || h[25:32])::BIGINT % 100 AS r4
  FROM d),
f AS (
  SELECT doc_id, t, n, least(c1, c2) AS a, greatest(c1, c2) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r3 >= 90 THEN 'plain' WHEN r4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM g),
c AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM c
"""


@_query
def op11_source_divergence(spark, sf_dir):
    return audit_sources(read(spark, sf_dir, "documents"))


ORACLES["op11_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
v AS (SELECT lang, count(term)::HUGEINT AS v, coalesce(sum(n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang FROM d) LEFT JOIN k USING (lang) GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (
  SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.total + v.v) AS p, 1 + 1000000000::HUGEINT * (k.n + 1) // (v.total + v.v) AS q
  FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM r)
WHERE part = 'pair' OR rank <= 200
"""


@_query
def op13_html_extraction(spark, sf_dir):
    return extract_text(read(spark, sf_dir, "pages"))


# the pages at hand all mark their article, and in it are headings, paragraphs, bold text and line breaks alone: SQL reads that pattern; other markup is held in tests
ORACLES["op13_html_extraction"] = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1) AS body FROM pages),
b AS (
  SELECT page_id, url, array_to_string(list_filter(list_transform(string_split_regex(body, '</?(?:p|h1)>'), lambda x:
    trim(regexp_replace(regexp_replace(replace(replace(regexp_replace(x, '</?b>', '', 'g'), '<br>', ' '), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text
  FROM a)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM b
"""

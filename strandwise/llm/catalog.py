"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (
    decontamination,
    fill_in_middle,
    fingerprints,
    html_text,
    language_id,
    mixing,
    near_dedup,
    packing,
    quality_classifier,
    quality_rules,
    ranked_search,
    suffix_tree_lm,
    url_filters,
)
from .common import read

#: The rules of the query, (verdict, host, path).
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(read(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents"))


def op6_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.score(read(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(read(spark, sf_dir, "pages"), url_filters.rule_table(spark, URL_RULES))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(read(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_near_dedup, op2_fingerprints, op3_html_text, op4_language_id, op5_quality_rules,
        op6_suffix_tree_lm, op7_url_filters, op8_quality_classifier, op9_mixing, op10_packing,
        op11_decontamination, op12_ranked_search, op13_fill_in_middle,
    )
}

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(quality_rules.STOP_WORDS))

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LEXICAL = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = {
    "op5_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln FROM d),
g AS (SELECT rid, i, list_slice(w, i, i + 2) AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ln) - len(list_distinct(ln)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(ln) AS BIGINT) AS n_lines,
  CAST(len(list_filter(w, lambda x: lower(rtrim(x, '.,;:?')) IN ({_STOP}))) AS BIGINT) AS n_stop,
  CAST(len(list_filter(w, lambda x: suffix(x, '!!'))) AS BIGINT) AS n_exclaimed,
  CAST(len(regexp_extract_all(t, '\p{{Lu}}')) AS BIGINT) AS n_upper, CAST(len(regexp_extract_all(t, '\p{{L}}')) AS BIGINT) AS n_letters
  FROM w LEFT JOIN c USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND word_chars / greatest(n_words, 1) BETWEEN 2.0 AND 16.0 AND n_symbols / greatest(n_words, 1) <= 0.1
  AND n_exclaimed / greatest(n_words, 1) <= 0.3 AND n_upper / greatest(n_letters, 1) <= 0.5
  AND n_letters / greatest(word_chars, 1) >= 0.6 AND n_stop / greatest(n_words, 1) >= 0.02
  AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AND n_repeat_words / greatest(n_words, 1) <= 0.5 AS kept FROM b
""",
    "op7_url_filters": r"""
WITH p AS (SELECT row_number() OVER () AS rid, page_id,
  CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT rid, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
f AS (SELECT u.*, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY rid ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS n
  FROM u LEFT JOIN r ON (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE n = 1
""",
    "op9_mixing": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM d GROUP BY source),
w AS (SELECT *, 1 + (rn - 1) % 3 AS w, 3 * source_size AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / w, rn) AS k, sum(cap) OVER (ORDER BY cap / w, rn) AS caps, sum(w) OVER (ORDER BY cap / w, rn) AS ws,
  sum(source_size) OVER () AS total, sum(w) OVER () AS allw FROM w),
v AS (SELECT (total - caps + cap) / (allw - ws + w) AS v FROM o WHERE (total - caps + cap) / (allw - ws + w) * w <= cap ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, least(v.v * w, CAST(cap AS DOUBLE)) AS target FROM w, v),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
g AS (SELECT source, h, sum(size) AS sz, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS cum FROM d WHERE size > 0 GROUP BY source, h),
b AS (SELECT p.source, min_by(h + CASE WHEN 2 * (target - whole * source_size - cum + sz) >= sz THEN 1 ELSE 0 END, h) AS upto
  FROM p JOIN g ON g.source IS NOT DISTINCT FROM p.source WHERE cum > target - whole * source_size GROUP BY p.source)
SELECT d.doc_id, d.size, p.source_size, p.target, (p.whole + CASE WHEN d.h < coalesce(b.upto, 0) THEN 1 ELSE 0 END) * d.size AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN b ON b.source IS NOT DISTINCT FROM d.source
""",
    "op11_decontamination": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_LEXICAL} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_LEXICAL} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
o AS (SELECT rid, i, k, item FROM dw JOIN bw USING (k, g)),
h AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM o) GROUP BY rid),
t AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM o) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, h.n IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
""",
    "op12_ranked_search": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_LEXICAL} AS w FROM documents),
c AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
i AS (SELECT DISTINCT item_id, unnest({_LEXICAL}) AS term FROM benchmark),
p AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, c GROUP BY term, n),
m AS (SELECT rid, doc_id, 50 + (50 * len(w) * n) // l AS m FROM d, c),
s AS (SELECT item_id, rid, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM i JOIN f USING (term) JOIN p USING (term) JOIN m USING (rid) GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 50
""",
    "op13_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2,
  CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
    WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
s AS (SELECT doc_id, t, CAST(len(u) AS BIGINT) AS n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m,
  array_to_string(u[b + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM s
""",
}

"""The thin queries over the driver's tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.llm import decontaminate, html_text, line_dedup, mixing, near_dup, pii, quality, substring_dedup, toxicity, url_filter

URL_RULES = [
    # Verdict, host, path prefix.
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("block", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~held_out).select("doc_id", "toxic"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality", "kept")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find_spans(docs, pii.fit(docs))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = url_filter.filter_urls(pages, url_filter.rule_table(spark, URL_RULES))
    return out.select("page_id", "host", "path", "rule", "verdict")


QUERIES = {
    f.__name__: f
    for f in (op1_mixing, op2_minhash, op3_lines, op4_decontaminate, op5_toxicity, op6_quality, op7_pii, op8_html, op9_substrings, op10_urls)
}

ORACLES = {
    "op1_mixing": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rnk FROM s0),
s2 AS (SELECT *, [3.0, 1.0, 2.0][((rnk - 1) % 3 + 1)::INT]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap,
              sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM s1),
s3 AS (SELECT *, sum(w) OVER () AS ws,
              coalesce(sum(cap) OVER (ORDER BY cap / w, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capb,
              coalesce(sum(w) OVER (ORDER BY cap / w, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wb FROM s2),
s4 AS (SELECT *, (budget - capb) * w >= cap * (ws - wb) AS full_ FROM s3),
s5 AS (SELECT *, sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER () AS cf, sum(CASE WHEN full_ THEN w ELSE 0 END) OVER () AS wf FROM s4),
s6 AS (SELECT source, source_size, CASE WHEN full_ THEN cap ELSE w * (budget - cf) / (ws - wf) END AS target FROM s5),
s7 AS (SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS whole FROM s6),
s8 AS (SELECT *, round(target)::BIGINT - whole * source_size AS rest FROM s7),
o AS (SELECT d.doc_id, d.size, s8.source_size, s8.target, s8.whole, s8.rest,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN s8 ON d.source IS NOT DISTINCT FROM s8.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM o""",
    "op2_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.i >= 75 * (x.n + y.n - p.i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op3_lines": r"""
WITH l AS (SELECT doc_id, i, x[i] AS line FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))),
m AS (SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS worded FROM l),
f AS (SELECT doc_id, i, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) AS k FROM m WHERE worded) WHERE k = 1),
t AS (SELECT DISTINCT doc_id, i, array_to_string(w[k : k + 4], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM f)),
n AS (SELECT doc_id, i, count(*) AS n FROM t GROUP BY 1, 2),
p AS (SELECT a.doc_id AS ad, a.i AS ai, b.doc_id AS bd, b.i AS bi, count(*) AS s FROM t a JOIN t b ON a.g = b.g AND (a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.i < b.i)) GROUP BY 1, 2, 3, 4),
gone AS (SELECT DISTINCT bd AS doc_id, bi AS i FROM p JOIN n x ON x.doc_id = ad AND x.i = ai JOIN n y ON y.doc_id = bd AND y.i = bi WHERE 4 * s >= 3 * (x.n + y.n - s)),
kept AS (SELECT doc_id, i, line FROM m WHERE NOT worded UNION ALL SELECT doc_id, i, line FROM m SEMI JOIN f USING (doc_id, i) ANTI JOIN gone USING (doc_id, i)),
j AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS kept, count(*) AS n FROM kept GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS n_lines,
  (CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END - coalesce(j.n, 0))::BIGINT AS n_removed,
  CASE WHEN text IS NOT NULL THEN sha256(coalesce(j.kept, '')) END AS kept_sha256
FROM documents d LEFT JOIN j USING (doc_id)""",
    "op9_substrings": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
g AS (SELECT h, min(doc_id) AS least FROM v GROUP BY h),
b AS (SELECT DISTINCT doc_id, i + unnest(range(50)) AS i FROM (SELECT doc_id, i FROM v JOIN g USING (h) WHERE least < doc_id)),
k AS (SELECT doc_id, i, w[i] AS word FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM w)),
j AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM k ANTI JOIN b USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(j.n, 0))::BIGINT AS n_removed, sha256(coalesce(j.kept, '')) AS kept_sha256
FROM w LEFT JOIN j USING (doc_id)""",
    "op4_decontaminate": r"""
WITH w AS (
  SELECT 0 AS side, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark),
s AS (SELECT DISTINCT side, id, array_to_string(w[i : i + 4], ' ') AS g
      FROM (SELECT side, id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT id, count(*) AS n FROM s WHERE side = 1 GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, any_value(n.n)::BIGINT AS n_shingles, count(*)::BIGINT AS n_shared
FROM s d JOIN s b ON d.g = b.g AND d.side = 0 AND b.side = 1 JOIN n ON n.id = b.id
GROUP BY d.id, b.id HAVING 100 * count(*) >= 75 * any_value(n.n)""",
    "op10_urls": r"""
WITH p AS (
  SELECT page_id,
         CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
r(verdict, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
m AS (SELECT p.*, (SELECT arg_max(r.rhost || r.rpath, length(r.rhost || r.rpath)) FROM r WHERE (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)) AS rule FROM p)
SELECT page_id, host, path, m.rule, coalesce(r.verdict, 'allow') AS verdict FROM m LEFT JOIN r ON m.rule = r.rhost || r.rpath""",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)

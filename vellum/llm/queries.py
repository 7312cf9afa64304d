"""One query for each operator, over its whole table with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import decontaminate, html, jaccard, licenses, neighbours, secrets, sentencepieces, substrings, tokenout, toxicity
from vellum.session import spread, table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.links(spread(table(spark, sf_dir, "documents")))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(spread(table(spark, sf_dir, "documents")))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(spread(table(spark, sf_dir, "pages")))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(spread(table(spark, sf_dir, "documents")))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenout.encode(spread(table(spark, sf_dir, "documents")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.reject(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbours(spread(table(spark, sf_dir, "embeddings")), every=neighbours.EVERY)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats(spread(table(spark, sf_dir, "documents")))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spread(table(spark, sf_dir, "documents")))


_ALL = (
    op1_ngram_jaccard_join, op2_secret_scan, op3_html_extraction, op4_sentencepiece, op5_token_output,
    op6_toxicity, op7_nearest_neighbours, op8_decontamination, op9_substring_dedup, op10_license_scan,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_WORDS = r"WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),"
_LINKS = f"""{_WORDS.replace('WITH', 'WITH RECURSIVE')}
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) ELSE [array_to_string(ws, ' ')] END) AS g FROM w WHERE len(ws) > 0),
k AS (SELECT doc_id, g, len(g) AS n, md5(array_to_string(list_sort(g), '|')) AS h FROM s),
r AS (SELECT h, n, min(doc_id) AS rep FROM k GROUP BY h, n),
e AS (SELECT r.rep, r.n, unnest(k.g) AS t FROM r JOIN k ON k.doc_id = r.rep),
c AS (SELECT a.rep AS x, b.rep AS y, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.t = b.t AND a.rep < b.rep GROUP BY ALL),
p AS (SELECT x, y FROM c WHERE c * 5 >= (na + nb - c) * 3),
l AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
reach AS (SELECT DISTINCT x, x AS y FROM l UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x),
u AS (SELECT x AS rep, min(y) AS class_id FROM reach GROUP BY x),
g AS (SELECT x AS rep, count(*) AS n_links FROM l GROUP BY x)
SELECT d.doc_id, coalesce(u.class_id, r.rep, d.doc_id) AS class_id, coalesce(g.n_links, 0) AS n_links
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN k ON d.doc_id = k.doc_id LEFT JOIN r ON k.h = r.h AND k.n = r.n LEFT JOIN u ON u.rep = r.rep LEFT JOIN g ON g.rep = r.rep
"""
_SPANS = f"""{_WORDS}
p AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + {substrings.LENGTH - 1}], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {substrings.LENGTH - 2})) AS i FROM w WHERE len(ws) >= {substrings.LENGTH})),
d AS (SELECT h FROM p GROUP BY h HAVING min(doc_id) <> max(doc_id)),
q AS (SELECT DISTINCT p.doc_id, p.i FROM p JOIN d ON p.h = d.h),
g AS (SELECT doc_id, i, sum(CASE WHEN i - prev <= {substrings.LENGTH} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM q))
SELECT doc_id, min(i) - 1 AS first_word, max(i) + {substrings.LENGTH} - min(i) AS n_words FROM g GROUP BY doc_id, part
"""

ORACLE: dict[str, str] = {"op1_ngram_jaccard_join": _LINKS, "op9_substring_dedup": _SPANS, "op10_license_scan": licenses.sql()}

"""The document path over whole tables: each document's text becomes a PDF, which the kernel reads again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.scalars import algorithm_name
from vellum.operators import corpus, rasters
from vellum.operators.record import Facts, to_json
from vellum.operators.text import plain_text
from vellum.plans.queries import query
from vellum.session import spread, table
from vellum.sources import samples
from vellum.sources.pdf import ALL, facts, split
from vellum.sources.synthesize import pdfs
from vellum.streaming import incremental

#: Lines as the synthesizer makes them: 80 characters, 50 to a page. The tables' texts are all in WinAnsi's set.
_LINES = """
WITH a AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '[\\x00-\\x09\\x0B-\\x1F\\x7F]', '', 'g'), chr(10)) AS ls FROM documents),
b AS (SELECT doc_id, i, ls[i] AS s FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM a)),
c AS (SELECT doc_id, i, k, substr(s, k * 80 + 1, 80) AS t FROM (SELECT *, unnest(range(0, (length(s) + 79) // 80)) AS k FROM b WHERE s <> '')),
l AS (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1 AS n FROM c),
"""


def made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, content): a document's language and source say which variant of a file its text becomes."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    field = F.when(F.col("source").endswith("1"), F.col("doc_id").cast("string"))
    ends = F.col("source").endswith
    font = F.when(ends("2"), "composite").when(ends("4"), "differences")
    secure = F.when(ends("3"), F.when(F.col("lang") == "en", 4).when(F.col("lang") == "de", 2).when(F.col("lang") == "fr", 3).otherwise(6))
    flags = {"flate": F.col("lang") != "de", "xref_stream": F.col("lang") == "fr", "ruled": ends("5"), "image": ends("7"), "field": field, "font": font, "packed": ends("0"), "secure": secure, "revised": ends("8"), "nested": ends("6")}
    return pdfs(d.select("doc_id", "text", *(c.alias(k) for k, c in flags.items())))


def documents(spark: SparkSession, sf_dir: str, *facets: str) -> Facts:
    """Every document's facts of the kinds that a query is about: the kernel passes over all files, whichever they are."""
    return Facts(made(spark, sf_dir), facets=facets or ALL)


def one(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """The same of one kind, for queries that go over it once: as it comes from the kernel, without a written table."""
    return split(facts(made(spark, sf_dir), facets=(kind,)), kind)


@query(_LINES + "p AS (SELECT doc_id, n // 50 AS page, string_agg(t || chr(10), '' ORDER BY n) || chr(10) AS t FROM l GROUP BY ALL) SELECT CAST(doc_id AS VARCHAR) AS doc_id, string_agg(t, '' ORDER BY page) AS text FROM p GROUP BY doc_id")
def pdf_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_text(one(spark, sf_dir, "run"))


@query(_LINES + "p AS (SELECT doc_id, n // 50 AS page, count(*) AS n, sum(length(t)) AS chars FROM l GROUP BY ALL) SELECT CAST(doc_id AS VARCHAR) AS doc_id, page::INT AS page, n AS runs, chars::BIGINT AS chars, CASE WHEN source LIKE '%5' THEN 5 ELSE 0 END::BIGINT AS rulings FROM p JOIN documents USING (doc_id)")
def pdf_page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = documents(spark, sf_dir, "page", "run")
    runs = f.runs.groupBy("doc_id", "page").agg(F.count("*").alias("runs"), F.sum(F.length("text")).alias("chars"))
    return f.pages.select("doc_id", "page", F.col("ruling_line_count").alias("rulings")).join(runs, ["doc_id", "page"]).select("doc_id", "page", "runs", "chars", "rulings")


@query(_LINES + "p AS (SELECT doc_id, max(n) // 50 + 1 AS pages FROM l GROUP BY doc_id) SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, unnest(range(0, coalesce(pages, 1)))::INT AS page, 'Im0' AS name, 1.882353 AS effective_dpi, true AS below_threshold, 0.25 AS page_area_fraction FROM documents d LEFT JOIN p USING (doc_id) WHERE d.source LIKE '%7'".replace("1.882353", "round(least(8 * 72.0::DOUBLE / 306, 8 * 72.0::DOUBLE / 396), 6)").replace("0.25 AS", "0.25::DOUBLE AS"))
def pdf_image_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, "page", "image").images.select("doc_id", "page", "name", F.round("effective_dpi", 6).alias("effective_dpi"), "below_threshold", F.round("page_area_fraction", 6).alias("page_area_fraction"))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'name' AS fqn, 'label' AS label, 'Tx' AS field_type, CAST(doc_id AS VARCHAR) AS value, 0 AS page FROM documents WHERE source LIKE '%1'")
def pdf_form_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one(spark, sf_dir, "field").select("doc_id", "fqn", "label", "field_type", "value", "page")


@query(_LINES + "g AS (SELECT doc_id, sum(length(t)) AS chars FROM l GROUP BY doc_id) SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, 'Processed' AS status, CASE WHEN d.source LIKE '%1' THEN 'FormBased' WHEN coalesce(chars, 0) >= 24 THEN 'DigitalText' WHEN d.source LIKE '%7' THEN 'ScannedImageOnly' ELSE 'DigitalText' END AS category FROM documents d LEFT JOIN g USING (doc_id)")
def pdf_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).outcomes().select("doc_id", "status", "category")


#: Pages with their runs and the share that glyphs cover: half an em each of 12 points, or as the composite font's
#: widths say, whose codes are a document's characters in order.
_COVER = _LINES + """
ch AS (SELECT l.doc_id, n // 50 AS page, unnest(string_split(t, '')) AS c FROM l JOIN documents d USING (doc_id) WHERE d.source LIKE '%2'),
co AS (SELECT doc_id, c, row_number() OVER (PARTITION BY doc_id ORDER BY unicode(c)) AS code FROM (SELECT DISTINCT doc_id, c FROM ch)),
wi AS (SELECT ch.doc_id, page, sum(CASE WHEN code = 1 THEN 0.6::DOUBLE WHEN code = 2 THEN 0.55::DOUBLE WHEN code <= 9 THEN 0.48::DOUBLE ELSE 0.5::DOUBLE END) AS em FROM ch JOIN co USING (doc_id, c) GROUP BY ALL),
pg AS (SELECT doc_id, n // 50 AS page, count(*) AS runs, sum(length(t)) * 0.5::DOUBLE AS em FROM l GROUP BY ALL),
every AS (SELECT d.doc_id, d.source, unnest(range(0, coalesce(k.pages, 1))) AS page FROM documents d LEFT JOIN (SELECT doc_id, max(n) // 50 + 1 AS pages FROM l GROUP BY doc_id) k USING (doc_id)),
f AS (SELECT e.doc_id, e.source, e.page, coalesce(pg.runs, 0) AS runs, round(least(1.0::DOUBLE, coalesce(wi.em, pg.em, 0) * 144 / (612 * 792)), 4) AS cover FROM every e LEFT JOIN pg USING (doc_id, page) LEFT JOIN wi USING (doc_id, page)),
"""
_CLASSES = _COVER + """
q AS (SELECT *, CASE WHEN source LIKE '%1' AND page = 0 THEN 'FormPage' WHEN runs >= 3 OR cover >= 0.01 THEN 'DigitalText' WHEN runs = 0 AND source NOT LIKE '%7' AND source NOT LIKE '%5' THEN 'Empty' WHEN source LIKE '%7' THEN 'ScannedImageOnly' WHEN source LIKE '%5' THEN 'TableOrComplexLayout' WHEN cover > 0 THEN 'DigitalText' ELSE 'Empty' END AS page_class FROM f)
"""


@query(_CLASSES + """SELECT CAST(doc_id AS VARCHAR) AS doc_id, page::INT AS page, page_class, (CASE WHEN page_class = 'FormPage' THEN 0.85 WHEN page_class = 'DigitalText' AND (runs >= 3 OR cover >= 0.01) THEN CASE WHEN cover < 0.02 THEN 0.55 ELSE 0.9 END WHEN page_class = 'Empty' AND runs = 0 THEN 1.0 WHEN page_class = 'TableOrComplexLayout' THEN 0.5 ELSE 0.4 END)::DOUBLE AS page_confidence FROM q""")
def pdf_page_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, "page", "run", "image", "field").classified().select("doc_id", "page", "page_class", "page_confidence")


@query(_CLASSES + """, tx AS (SELECT doc_id, md5(string_agg(t, chr(10) ORDER BY n)) AS texts, count(*) AS runs FROM l GROUP BY doc_id),
cl AS (SELECT doc_id, string_agg(page_class, ',' ORDER BY page) AS classes, count(*) AS pages FROM q GROUP BY doc_id)
SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, '1.2' AS schema_version, 'Processed' AS status, cl.pages::INT AS pages, CASE WHEN d.source NOT LIKE '%3' THEN 'None' WHEN lang = 'en' THEN 'AES-128' WHEN lang IN ('de', 'fr') THEN 'RC4' ELSE 'AES-256' END AS algorithm, coalesce(tx.runs, 0)::INT AS runs, coalesce(tx.texts, md5('')) AS texts,
CASE WHEN d.source LIKE '%1' THEN 'f0' WHEN tx.runs > 0 THEN 't' || (tx.runs - 1) END AS last_item, CASE WHEN d.source LIKE '%1' THEN CAST(d.doc_id AS VARCHAR) END AS field, CASE WHEN d.source LIKE '%7' THEN cl.pages ELSE 0 END::INT AS images, cl.classes
FROM documents d JOIN cl USING (doc_id) LEFT JOIN tx USING (doc_id)""")
def pdf_coverage_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document's JSON record says, read back from the JSON."""
    kind = "struct<schemaVersion:string,status:string,pageCount:int,security:struct<algorithm:string>,textRuns:array<struct<text:string>>,coverage:array<struct<id:string>>,form:struct<fields:array<struct<value:string>>>,images:array<struct<page:int>>,pages:array<struct<index:int,class:string>>>"
    r = to_json(documents(spark, sf_dir).records()).select("doc_id", F.from_json("json", kind).alias("r"))
    return r.select(
        "doc_id", F.col("r.schemaVersion").alias("schema_version"), "r.status", F.col("r.pageCount").alias("pages"), "r.security.algorithm", F.size("r.textRuns").alias("runs"), F.md5(F.array_join("r.textRuns.text", "\n").cast("binary")).alias("texts"),
        F.try_element_at("r.coverage.id", F.lit(-1)).alias("last_item"), F.try_element_at("r.form.fields.value", F.lit(1)).alias("field"), F.size("r.images").alias("images"), F.array_join("r.pages.class", ",").alias("classes"),
    )


@query(_LINES + """g AS (SELECT doc_id, sum(length(t)) AS chars, max(n) // 50 + 1 AS pages FROM l GROUP BY doc_id),
o AS (SELECT d.source, d.lang, coalesce(pages, 1) AS pages, CASE WHEN d.source LIKE '%1' THEN 'FormBased' WHEN coalesce(chars, 0) >= 24 THEN 'DigitalText' WHEN d.source LIKE '%7' THEN 'ScannedImageOnly' ELSE 'DigitalText' END AS category FROM documents d LEFT JOIN g USING (doc_id)),
ag AS (SELECT count(*) AS total, sum(pages) AS pages, count(*) FILTER (source LIKE '%3') AS encrypted, count(*) FILTER (source LIKE '%1') AS forms, coalesce(sum(pages) FILTER (source LIKE '%7'), 0) AS images, count(*) FILTER (category = 'DigitalText') AS c1, count(*) FILTER (category = 'ScannedImageOnly') AS c2, count(*) FILTER (category = 'FormBased') AS c3, count(*) FILTER (source LIKE '%3' AND lang IN ('de', 'fr')) AS a1, count(*) FILTER (source LIKE '%3' AND lang = 'en') AS a2, count(*) FILTER (source LIKE '%3' AND lang = 'es') AS a3 FROM o)
SELECT total, total AS processed, 0::BIGINT AS rejected, pages::BIGINT AS pages, images::BIGINT AS images, images::BIGINT AS images_below, round_even(100.0 * encrypted / total, 1)::DOUBLE AS encrypted_percent, round_even(100.0 * forms / total, 1)::DOUBLE AS form_percent,
array_to_string(list_filter(['DigitalText=' || c1, 'ScannedImageOnly=' || c2, 'FormBased=' || c3], lambda x: x NOT LIKE '%=0'), ',') AS categories, array_to_string(list_filter(['Rc4=' || a1, 'Aes128=' || a2, 'Aes256=' || a3], lambda x: x NOT LIKE '%=0'), ',') AS algorithms FROM ag""")
def pdf_corpus_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = corpus.aggregate(documents(spark, sf_dir).outcomes())
    named = lambda c: F.array_join(F.transform(c, lambda r: F.concat_ws("=", r["name"], r["count"].cast("string"))), ",").alias(c)
    return a.select("total", "processed", "rejected", F.col("pages").cast("long").alias("pages"), F.col("images").cast("long").alias("images"), F.col("images_below").cast("long").alias("images_below"), "encrypted_percent", "form_percent", named("categories"), named("algorithms"))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, source LIKE '%3' AS encrypted, CASE WHEN source NOT LIKE '%3' THEN 'None' WHEN lang = 'en' THEN 'AES-128' WHEN lang IN ('de', 'fr') THEN 'RC4' ELSE 'AES-256' END AS algorithm, CASE WHEN source NOT LIKE '%3' THEN 0 WHEN lang = 'en' THEN 4 WHEN lang = 'de' THEN 2 WHEN lang = 'fr' THEN 3 ELSE 6 END AS revision, CASE WHEN source LIKE '%3' THEN 'UserPassword' ELSE 'NotRequired' END AS authentication FROM documents")
def pdf_security(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one(spark, sf_dir, "document").select("doc_id", F.col("is_encrypted").alias("encrypted"), algorithm_name(F.col("algorithm")).alias("algorithm"), "revision", "authentication")


@query(_LINES + "g AS (SELECT doc_id, sum(length(t)) AS chars FROM l GROUP BY doc_id) SELECT CAST(doc_id AS VARCHAR) AS doc_id, source LIKE '%2' AS composite, chars::BIGINT AS authoritative, 0::BIGINT AS fallback, 0::BIGINT AS unmapped, 1::BIGINT AS fonts FROM g JOIN documents USING (doc_id)")
def pdf_decode_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the codes of each document's fonts were read, by encodings, names of differences and code maps."""
    f = documents(spark, sf_dir, "page", "run")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").endswith("2").alias("composite"))
    fonts = f.pages.groupBy("doc_id").agg(F.max("font_distinct_count").cast("long").alias("fonts"))
    sums = f.runs.groupBy("doc_id").agg(*(F.sum(c).cast("long").alias(c) for c in ("authoritative", "fallback", "unmapped")))
    return sums.join(fonts, "doc_id").join(d, "doc_id").select("doc_id", "composite", "authoritative", "fallback", "unmapped", "fonts")


_PIXELS = """
WITH g AS (SELECT y, x FROM range(16) a(y), range(24) b(x)),
s AS (
  SELECT 'flat' AS rule, y, x, 0 AS c, 40 + 50 * (x // 8) + 20 * (y // 8) AS v FROM g
  UNION ALL SELECT 'gray', y, x, 0, (7 * x + 13 * y) % 251 FROM g WHERE x < 20
  UNION ALL SELECT 'rgb', y, x, c, (7 * x + 13 * y + 50 * c) % 251 FROM g, range(3) d(c) WHERE x < 20
  UNION ALL SELECT 'indexed', y, x, c, CASE c WHEN 0 THEN (7 * x + 13 * y) % 251 ELSE ((7 * x + 13 * y) % 251 + 50 * c) % 251 END FROM g, range(3) d(c) WHERE x < 20
  UNION ALL SELECT 'bits', y, x, 0, CASE WHEN (x * 3 + y * 5) % 7 < 3 THEN 0 ELSE 255 END FROM g WHERE x < 20
  UNION ALL SELECT 'tint', y, x, c, (7 * x + 13 * y) % 251 FROM g, range(3) d(c) WHERE x < 20
  UNION ALL SELECT 'white', y, x, c, 255 FROM g, range(3) d(c) WHERE x < 20
),
n AS (SELECT rule, count(DISTINCT x) AS width, count(DISTINCT y) AS height, max(c) + 1 AS components FROM s GROUP BY rule),
m AS (SELECT s.rule, width, height, components, sum(v) AS total, sum(v * (1 + ((y * width + x) * components + c) % 97)) AS weighted FROM s JOIN n USING (rule) GROUP BY ALL),
k(i, rule) AS (VALUES (0, 'flat'), (1, 'flat'), (2, 'bits'), (3, 'bits'), (4, 'rgb'), (5, 'rgb'), (6, 'gray'), (7, 'gray'), (8, 'indexed'), (9, 'white'), (10, 'tint'), (11, 'bits'))
SELECT CAST(doc_id AS VARCHAR) AS doc_id, width::INT AS width, height::INT AS height, components::INT AS components, total::BIGINT AS total, weighted::BIGINT AS weighted FROM documents JOIN k ON doc_id % 12 = k.i JOIN m USING (rule)
"""


@query(_PIXELS)
def pdf_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of an image of each codec and colour space, as their sum and a sum weighted by place."""
    made = samples.pictures(spread(table(spark, sf_dir, "documents").select("doc_id")))
    r = rasters.color_images(made)
    return rasters.sums(r.where("error IS NULL"), 97)


@query("SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = incremental.windows(table(spark, sf_dir, "events"))
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))

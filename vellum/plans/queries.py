"""The operators over the driver's tables: each query makes its input from a table as it stands and calls the
operator that the document path uses; the SQL says the same for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import scalars as S
from vellum.operators import corpus, documents, images, ocr, pages, text, trees
from vellum.session import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


# Image placements from lineitem.


def placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_partkey") % 3000 + 100).alias("px_w"), (F.col("l_suppkey") % 3000 + 100).alias("px_h"),
        (F.col("l_quantity") * 12).alias("a"), (F.col("l_discount") * 100).alias("b"), (F.col("l_tax") * 100).alias("c"), (F.col("l_extendedprice") / 100).alias("d"),
        F.lit(612.0).alias("page_width"), F.lit(792.0).alias("page_height"),
    )


_DPI = """
WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey % 3000 + 100 AS px_w, l_suppkey % 3000 + 100 AS px_h, sqrt(pow(l_quantity * 12, 2) + pow(l_discount * 100, 2)) AS w, sqrt(pow(l_tax * 100, 2) + pow(l_extendedprice / 100, 2)) AS h FROM lineitem),
q AS (SELECT *, CASE WHEN w > 0 THEN px_w * 72.0::DOUBLE / w ELSE 0 END AS x, CASE WHEN h > 0 THEN px_h * 72.0::DOUBLE / h ELSE 0 END AS y FROM p),
e AS (SELECT *, CASE WHEN x > 0 AND y > 0 THEN least(x, y) ELSE greatest(x, y) END AS dpi FROM q)
"""


@query(_DPI + "SELECT l_orderkey, l_linenumber, round(x, 6) AS horizontal_dpi, round(y, 6) AS vertical_dpi, round(dpi, 6) AS effective_dpi, dpi > 0 AND dpi < 150 AS below_threshold, round(least(1.0::DOUBLE, w * h / (612.0::DOUBLE * 792.0::DOUBLE)), 6) AS page_area_fraction FROM e")
def dpi_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = images.resolution(placements(spark, sf_dir))
    return r.select("l_orderkey", "l_linenumber", *(F.round(c, 6).alias(c) for c in ("horizontal_dpi", "vertical_dpi", "effective_dpi")), "below_threshold", F.round("page_area_fraction", 6).alias("page_area_fraction"))


@query(_DPI + "SELECT count(*) AS images, round_even(min(dpi), 1) AS min_dpi, round_even(quantile_disc(dpi, 0.5), 1) AS median_dpi, round_even(quantile_disc(dpi, 0.95), 1) AS p95_dpi, count(*) FILTER (dpi < 150) AS below, round_even(100.0::DOUBLE * count(*) FILTER (dpi < 150) / count(*), 1) AS below_percent FROM e WHERE dpi > 0")
def dpi_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.dpi_statistics(images.resolution(placements(spark, sf_dir)))


@query(_DPI + "SELECT o.i AS ordinal, o.b AS bucket, count(e.dpi) AS count FROM (VALUES (0, '<150', 0, 150), (1, '150-299', 150, 300), (2, '300-599', 300, 600), (3, '>=600', 600, 1e300)) o(i, b, lo, hi) LEFT JOIN e ON e.dpi > 0 AND e.dpi >= o.lo AND e.dpi < o.hi GROUP BY ALL")
def dpi_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.dpi_histogram(images.resolution(placements(spark, sf_dir)))


@query("SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN 'FlateDecode' ELSE 'FlateDecode+' || l_returnflag END AS chain, CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN 'FlateDecode' ELSE l_returnflag END AS codec FROM lineitem")
def filter_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_linenumber") % 3
    chain = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("FlateDecode"))).otherwise(F.array(F.lit("FlateDecode"), F.col("l_returnflag")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", images.chain_name(chain).alias("chain"), images.codec(chain).alias("codec"))


@query("""
WITH pl AS (SELECT l_orderkey % 100 AS doc_id, l_orderkey AS page, sum((l_quantity * 6) * (l_extendedprice / 1000)) AS area FROM lineitem GROUP BY 1, 2),
pg AS (SELECT o_orderkey % 100 AS doc_id, o_orderkey AS page FROM orders)
SELECT doc_id, round(max(least(1.0::DOUBLE, coalesce(area, 0) / (612.0::DOUBLE * 792.0::DOUBLE))), 6) AS image_area_fraction FROM pg LEFT JOIN pl USING (doc_id, page) GROUP BY doc_id
""")
def image_area_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 100).alias("doc_id"), F.col("l_orderkey").alias("page"), (F.col("l_quantity") * 6).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"), (F.col("l_extendedprice") / 1000).alias("d"))
    g = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 100).alias("doc_id"), F.col("o_orderkey").alias("page"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))
    return images.largest_area_fraction(p, g).select("doc_id", F.round("image_area_fraction", 6).alias("image_area_fraction"))


# Pages: an order is a page, its lines are runs and images.


def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    key = [(F.col("l_orderkey") % 1000).alias("doc_id"), F.col("l_orderkey").alias("page")]
    g = o.select((F.col("o_orderkey") % 1000).alias("doc_id"), F.col("o_orderkey").alias("page"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))
    tier = lambda flag, n: F.when(F.col("l_returnflag") == flag, n).otherwise(0)
    runs = li.where("l_quantity <= 40").select(*key, (F.col("l_linenumber") == 7).alias("is_ocr_layer"), (F.col("l_quantity") * 9).alias("x"), (F.col("l_quantity") * 4).alias("width"), F.lit(12.0).alias("font_size"), tier("N", 8).alias("authoritative"), tier("A", 4).alias("fallback"), tier("R", 2).alias("unmapped"))
    im = li.where("l_quantity > 40").select(*key, (F.col("l_partkey") % 3000 + 100).alias("px_w"), (F.col("l_suppkey") % 3000 + 100).alias("px_h"), (F.col("l_quantity") * 12).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"), (F.col("l_tax") * 11 * 792).alias("d"), F.lit(612.0).alias("page_width"), F.lit(792.0).alias("page_height"))
    fields = o.where("o_orderpriority >= '5'").select((F.col("o_orderkey") % 1000).alias("doc_id"), F.col("o_orderkey").alias("page"))
    structure = o.select((F.col("o_orderkey") % 1000).alias("doc_id"), F.col("o_orderkey").alias("page"), (F.col("o_orderkey") % 20).alias("ruling_line_count"), (F.col("o_orderkey") % 4).alias("font_distinct_count"))
    return pages.signals(g, runs, images.resolution(im), fields, structure)


_SIGNALS = """
WITH r AS (SELECT l_orderkey AS page, l_linenumber = 7 AS ocr, l_quantity * 9 AS x, l_quantity * 4 AS width, CASE WHEN l_returnflag = 'N' THEN 8 ELSE 0 END AS au, CASE WHEN l_returnflag = 'A' THEN 4 ELSE 0 END AS fa, CASE WHEN l_returnflag = 'R' THEN 2 ELSE 0 END AS un FROM lineitem WHERE l_quantity <= 40),
t AS (SELECT page, count(*) AS n, sum(abs(width) * 12.0::DOUBLE) AS covered, sum(au) AS au, sum(fa) AS fa, sum(un) AS un FROM r WHERE NOT ocr GROUP BY page),
oc AS (SELECT page, bool_or(ocr) AS ocr FROM r GROUP BY page),
i AS (SELECT l_orderkey AS page, (l_quantity * 12) AS w, abs(l_tax * 11 * 792) AS h, l_partkey % 3000 + 100 AS px_w, l_suppkey % 3000 + 100 AS px_h FROM lineitem WHERE l_quantity > 40),
i2 AS (SELECT page, least(1.0::DOUBLE, w * h / (612.0::DOUBLE * 792.0::DOUBLE)) AS area, CASE WHEN w > 0 THEN px_w * 72.0::DOUBLE / w ELSE 0 END AS x, CASE WHEN h > 0 THEN px_h * 72.0::DOUBLE / h ELSE 0 END AS y FROM i),
im AS (SELECT page, max(area) AS area, min(CASE WHEN x > 0 AND y > 0 THEN least(x, y) ELSE nullif(greatest(x, y), 0) END) AS dpi, count(*) AS n FROM i2 GROUP BY page),
b AS (SELECT page, round(x / 3.0::DOUBLE)::BIGINT AS k, count(*) AS n FROM r WHERE NOT ocr GROUP BY ALL),
cs AS (SELECT page, CASE WHEN sum(n) < 6 OR count(*) FILTER (n >= 3) < 2 THEN 0 ELSE round(coalesce(sum(n) FILTER (n >= 3), 0)::DOUBLE / sum(n), 4) END AS score FROM b GROUP BY page),
s AS (SELECT o_orderkey % 1000 AS doc_id, o_orderkey AS page, coalesce(t.n, 0) AS text_run_count, round(least(1.0::DOUBLE, coalesce(covered, 0) / (612.0::DOUBLE * 792.0::DOUBLE)), 4) AS text_coverage_fraction, o_orderpriority >= '5' AS has_acro_form_widgets, CASE WHEN o_orderpriority >= '5' THEN 1 ELSE 0 END AS widget_count,
 coalesce(im.area, 0) >= 0.8 AS is_image_only, coalesce(oc.ocr, false) AS ocr_layer_present, round(coalesce(im.dpi, 0), 1) AS min_image_dpi, coalesce(im.n, 0) AS image_count, o_orderkey % 20 AS ruling_line_count, coalesce(score, 0) AS column_alignment_score, o_orderkey % 4 AS font_distinct_count,
 CASE WHEN coalesce(au + fa + un, 0) > 0 THEN round((au + 0.25::DOUBLE * fa) / (au + fa + un), 4) ELSE 1.0 END AS text_decode_confidence
 FROM orders LEFT JOIN t ON t.page = o_orderkey LEFT JOIN oc ON oc.page = o_orderkey LEFT JOIN im ON im.page = o_orderkey LEFT JOIN cs ON cs.page = o_orderkey),
d AS (SELECT *, text_run_count >= 3 OR text_coverage_fraction >= 0.01 AS txt, ruling_line_count >= 12 OR column_alignment_score >= 0.6 AS tab FROM s),
c AS (SELECT *, CASE WHEN is_image_only AND txt THEN 'Mixed' WHEN is_image_only AND ocr_layer_present THEN 'ScannedWithOcr' WHEN is_image_only THEN 'ScannedImageOnly' WHEN has_acro_form_widgets AND tab THEN 'Mixed' WHEN has_acro_form_widgets THEN 'FormPage' WHEN tab AND txt THEN 'TableOrComplexLayout' WHEN txt THEN 'DigitalText'
 WHEN text_run_count = 0 AND image_count = 0 AND ruling_line_count = 0 THEN 'Empty' WHEN image_count > 0 THEN 'ScannedImageOnly' WHEN ruling_line_count > 0 THEN 'TableOrComplexLayout' WHEN text_run_count > 0 AND text_coverage_fraction > 0 THEN 'DigitalText' ELSE 'Empty' END AS page_class,
 CASE WHEN is_image_only AND txt THEN 0.7 WHEN is_image_only THEN 0.9 WHEN has_acro_form_widgets AND tab THEN 0.7 WHEN has_acro_form_widgets THEN 0.85 WHEN tab AND txt THEN 0.7 WHEN txt AND text_coverage_fraction < 0.02 THEN 0.55 WHEN txt THEN 0.9 WHEN text_run_count = 0 AND image_count = 0 AND ruling_line_count = 0 THEN 1.0 WHEN image_count > 0 THEN 0.4 WHEN ruling_line_count > 0 THEN 0.5 ELSE 0.4 END AS page_confidence FROM d)
"""
_COLUMNS = "doc_id, page, text_run_count, text_coverage_fraction, has_acro_form_widgets, CAST(widget_count AS BIGINT) AS widget_count, is_image_only, ocr_layer_present, min_image_dpi, image_count, ruling_line_count, column_alignment_score, font_distinct_count, text_decode_confidence"


@query(_SIGNALS + f"SELECT {_COLUMNS} FROM s")
def page_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_facts(spark, sf_dir)


@query(_SIGNALS + "SELECT doc_id, page, page_class, CAST(page_confidence AS DOUBLE) AS page_confidence FROM c")
def page_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.decide(page_facts(spark, sf_dir)).select("doc_id", "page", "page_class", "page_confidence")


@query(_SIGNALS + """, m AS (SELECT doc_id, page_class, CASE page_class WHEN 'TableOrComplexLayout' THEN 'DigitalText' WHEN 'Empty' THEN NULL WHEN 'FormPage' THEN NULL ELSE page_class END AS k FROM c)
SELECT doc_id, CASE WHEN bool_or(page_class = 'FormPage') THEN 'FormBased' WHEN count(k) = 0 THEN 'DigitalText' WHEN count(DISTINCT k) = 1 THEN min(k) ELSE 'Mixed' END AS category FROM m GROUP BY doc_id""")
def page_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.roll_up(pages.decide(page_facts(spark, sf_dir)))


@query("""
WITH b AS (SELECT l_orderkey % 500 AS page, round(l_quantity * 9 / 3.0::DOUBLE)::BIGINT AS k, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT page, CASE WHEN sum(n) < 6 OR count(*) FILTER (n >= 3) < 2 THEN 0.0 ELSE round(coalesce(sum(n) FILTER (n >= 3), 0)::DOUBLE / sum(n), 4) END AS column_alignment_score FROM b GROUP BY page
""")
def column_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("page"), (F.col("l_quantity") * 9).alias("x"))
    return pages.column_score(runs, ["page"])


@query("SELECT l_orderkey, round((sum(CASE WHEN l_returnflag = 'N' THEN 8 ELSE 0 END) + 0.25::DOUBLE * sum(CASE WHEN l_returnflag = 'A' THEN 4 ELSE 0 END)) / nullif(sum(CASE l_returnflag WHEN 'N' THEN 8 WHEN 'A' THEN 4 WHEN 'R' THEN 2 ELSE 0 END), 0), 4) AS confidence FROM lineitem GROUP BY l_orderkey")
def decode_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = lambda flag, n: F.sum(F.when(F.col("l_returnflag") == flag, n).otherwise(0))
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(tier("N", 8).alias("a"), tier("A", 4).alias("f"), tier("R", 2).alias("u"))
    return g.select("l_orderkey", pages.decode_confidence(F.col("a"), F.col("f"), F.col("u")).alias("confidence"))


@query("SELECT l_partkey AS object, min(l_orderkey) AS page FROM lineitem GROUP BY l_partkey")
def widget_first_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.first_page(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("object"), F.col("l_orderkey").alias("page")))


# Documents and the corpus: an order is a document's outcome.

_OUTCOME = """
WITH g AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity)::BIGINT AS chars, max(l_tax) * 11 AS share, bool_or(l_linenumber = 6) AS ocr, list(px * 72.0::DOUBLE / 36 ORDER BY l_linenumber) AS dpis FROM (SELECT *, l_partkey % 3000 + 100 AS px FROM lineitem) GROUP BY l_orderkey),
k AS (SELECT o_orderkey AS id, sha256(concat_ws('|', o_orderkey, o_custkey, o_orderstatus)) AS input_hash, o_orderstatus = 'P' AS rej, o_orderstatus = 'F' AND o_orderkey % 11 = 0 AS enc, o_orderkey % 13 = 0 AND o_orderstatus <> 'P' AS unread, CASE WHEN o_orderpriority >= '5' THEN 2 ELSE 0 END AS fields, coalesce(share, 0) AS share, coalesce(ocr, false) AS ocr, coalesce(chars, 0) AS chars, coalesce(n, 0) AS n, coalesce(dpis, []) AS dpis, o_orderpriority AS pr FROM orders LEFT JOIN g ON l_orderkey = o_orderkey),
u AS (SELECT *, CASE WHEN rej THEN 'Rejected' WHEN unread THEN 'EncryptedUnreadable' WHEN fields > 0 THEN 'FormBased' WHEN share >= 0.8 AND ocr THEN 'ScannedWithOcr' WHEN share >= 0.8 AND chars >= 24 THEN 'Mixed' WHEN share >= 0.8 THEN 'ScannedImageOnly' WHEN chars >= 24 THEN 'DigitalText' WHEN n > 0 THEN 'ScannedImageOnly' ELSE 'DigitalText' END AS category,
 CASE WHEN enc THEN CASE WHEN id % 2 = 0 THEN 'Rc4' ELSE 'Aes256' END ELSE 'None' END AS alg, CASE WHEN rej THEN CASE substr(pr, 1, 1) WHEN '1' THEN 'MissingHeader' WHEN '2' THEN 'MissingEof' ELSE 'MalformedObject' END ELSE 'None' END AS why FROM k)
"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    dpi = F.array_sort(F.collect_list(F.struct("l_linenumber", ((F.col("l_partkey") % 3000 + 100) * F.lit(72.0) / 36).alias("v"))))
    g = li.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("chars"), (F.max("l_tax") * 11).alias("share"), F.bool_or(F.col("l_linenumber") == 6).alias("ocr"), F.transform(dpi, lambda s: s["v"]).alias("dpis"))
    j = o.join(g, o.o_orderkey == g.l_orderkey, "left")
    rejected, zero = F.col("o_orderstatus") == "P", F.lit(0).cast("long")
    unreadable = (F.col("o_orderkey") % 13 == 0) & ~rejected
    fields = F.when(F.col("o_orderpriority") >= "5", 2).otherwise(0)
    dpis = F.coalesce("dpis", F.array().cast("array<double>"))
    encrypted = (F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 11 == 0)
    first = F.substring("o_orderpriority", 1, 1)
    return j.select(
        F.col("o_orderkey").alias("id"), F.sha2(F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderstatus"), 256).alias("input_hash"),
        F.when(rejected, "Rejected").otherwise("Processed").alias("status"),
        documents.category(rejected, unreadable, fields, F.coalesce("share", F.lit(0.0)), F.coalesce("ocr", F.lit(False)), F.coalesce("chars", zero), F.coalesce("n", zero)).alias("category"),
        F.coalesce("n", zero).alias("page_count"), F.coalesce("ocr", F.lit(False)).alias("ocr_present"), (fields > 0).alias("form_present"),
        F.when(encrypted, F.when(F.col("o_orderkey") % 2 == 0, "Rc4").otherwise("Aes256")).otherwise("None").alias("encryption_algorithm"), encrypted.alias("encrypted"), unreadable.alias("encrypted_unreadable"),
        F.when(rejected, F.when(first == "1", "MissingHeader").when(first == "2", "MissingEof").otherwise("MalformedObject")).otherwise("None").alias("rejection"),
        F.lit(150).alias("threshold"), F.size(F.filter(dpis, lambda v: v < 150)).cast("long").alias("below_threshold_count"), dpis.alias("effective_dpis"),
    )


@query(_OUTCOME + "SELECT id, category FROM u")
def doc_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes(spark, sf_dir).select("id", "category")


def _counted(name: str, test: str, values: list[str]) -> str:
    order = ", ".join(f"'{v}'" for v in values)
    return _OUTCOME + f"SELECT {name} AS name, count(*) AS count, round_even(100.0::DOUBLE * count(*) / (SELECT count(*) FROM u), 1) AS percent, list_position([{order}], {name})::INT AS ordinal FROM u WHERE {test} GROUP BY {name}"


def _ranked(spark: SparkSession, sf_dir: str, column: str, test: str, values: list[str]) -> DataFrame:
    o = outcomes(spark, sf_dir)
    total = o.agg(F.count("*").alias("_all"))
    rows = o.where(test).groupBy(F.col(column).alias("name")).agg(F.count("*").alias("count")).crossJoin(F.broadcast(total))
    order = F.array_position(F.array(*map(F.lit, values)), F.col("name"))
    return rows.select("name", "count", S.percent(F.col("count"), F.col("_all")).alias("percent"), order.cast("int").alias("ordinal"))


@query(_counted("category", "true", documents.CATEGORIES))
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.counts(outcomes(spark, sf_dir), "category", documents.CATEGORIES)


@query(_counted("alg", "enc AND alg <> 'None'", corpus.ALGORITHMS))
def algorithms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir, "encryption_algorithm", "encrypted AND encryption_algorithm <> 'None'", corpus.ALGORITHMS)


@query(_counted("why", "rej AND why <> 'None'", corpus.REASONS))
def rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir, "rejection", "status = 'Rejected' AND rejection <> 'None'", corpus.REASONS)


@query(_OUTCOME + """, v AS (SELECT unnest(dpis) AS d FROM u)
SELECT count(*) AS total, count(*) FILTER (NOT rej) AS processed, count(*) FILTER (rej) AS rejected, count(*) FILTER (unread) AS encrypted_unreadable, round_even(100.0::DOUBLE * count(*) FILTER (enc) / count(*), 1) AS encrypted_percent, round_even(100.0::DOUBLE * count(*) FILTER (NOT rej AND ocr) / count(*) FILTER (NOT rej), 1) AS ocr_percent,
 round_even(100.0::DOUBLE * count(*) FILTER (NOT rej AND fields > 0) / count(*) FILTER (NOT rej), 1) AS form_percent, 150 AS threshold, sum(n)::BIGINT AS pages, (SELECT count(*) FROM v WHERE d < 150) AS images_below, (SELECT count(*) FROM v WHERE d > 0) AS images, (SELECT round_even(min(d), 1) FROM v) AS min_dpi, (SELECT round_even(quantile_disc(d, 0.5), 1) FROM v) AS median_dpi,
 (SELECT round_even(quantile_disc(d, 0.95), 1) FROM v) AS p95_dpi, (SELECT round_even(100.0::DOUBLE * count(*) FILTER (d < 150) / count(*), 1) FROM v) AS images_below_percent FROM u""")
def corpus_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.aggregate(outcomes(spark, sf_dir)).drop("categories", "algorithms", "rejections", "histogram")


_LEDGER = "l AS (SELECT o_orderkey AS id, sha256(concat_ws('|', o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END)) AS input_hash FROM orders WHERE o_orderpriority < '4'), f AS (SELECT o_orderkey AS id, sha256(concat_ws('|', o_orderkey, o_custkey, o_orderstatus)) AS input_hash FROM orders)"


def ledger(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    key = lambda status: F.sha2(F.concat_ws("|", "o_orderkey", "o_custkey", status), 256).alias("input_hash")
    files = o.select(F.col("o_orderkey").alias("id"), key(F.col("o_orderstatus")))
    known = o.where("o_orderpriority < '4'").select(F.col("o_orderkey").alias("id"), key(F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus"))))
    return files, known


@query(f"WITH {_LEDGER} SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.id = f.id AND l.input_hash = f.input_hash)")
def resume_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.to_do(*ledger(spark, sf_dir))


@query(f"WITH {_LEDGER} SELECT * FROM l WHERE EXISTS (SELECT 1 FROM f WHERE l.id = f.id AND l.input_hash = f.input_hash)")
def resume_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.reusable(*ledger(spark, sf_dir))


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def ledger_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.last_wins(table(spark, sf_dir, "events"), "user_id", "event_id").select("user_id", "event_id", "event_type", "value")


# Text: a conversation is a document, its turns are runs.

_PLAIN = "coalesce(text, '')"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.lit(0).alias("page"), F.col("turn").alias("run_id"), t.alias("text"), ((F.col("turn") % 3) * 100).cast("double").alias("x"),
        (F.lit(100.0) - F.floor(F.col("turn") / 3) * 12).alias("y"), (F.least(F.length(t), F.lit(12)) * 8.3).alias("width"), F.lit(12.0).alias("font_size"), F.lit(0.25).alias("space_width_em"), "role",
    )


@query(f"""
WITH r AS (SELECT conv_id, turn, {_PLAIN} AS t, (turn % 3) * 100.0::DOUBLE AS x, 100 - floor(turn / 3) * 12 AS y FROM conversations),
w AS (SELECT *, least(length(t), 12) * 8.3::DOUBLE AS width FROM r),
p AS (SELECT *, lag(x + width) OVER o AS pr, lag(t) OVER o AS pt FROM w WINDOW o AS (PARTITION BY conv_id, y ORDER BY x, turn)),
l AS (SELECT conv_id, y, string_agg(CASE WHEN pt IS NOT NULL AND NOT regexp_matches(pt, '\\s$') AND NOT regexp_matches(t, '^\\s') AND x - pr > 1.5 THEN ' ' ELSE '' END || t, '' ORDER BY x, turn) || chr(10) AS t FROM p GROUP BY conv_id, y)
SELECT conv_id AS doc_id, string_agg(t, '' ORDER BY y DESC) || chr(10) AS text FROM l GROUP BY conv_id
""")
def plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.plain_text(runs(spark, sf_dir))


@query(f"""
WITH t AS (SELECT conv_id AS doc_id, 't' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS id, 'text' AS kind, {_PLAIN} AS value, 0 AS page FROM conversations),
f AS (SELECT doc_id, 'f' || (row_number() OVER (PARTITION BY doc_id ORDER BY quality, toxic) - 1) AS id, CASE WHEN toxic = 1 THEN 'checkbox' ELSE 'field' END AS kind, CASE WHEN toxic = 1 THEN CASE WHEN quality = 1 THEN 'true' ELSE 'false' END ELSE 'q' END AS value, -1 AS page FROM labels WHERE toxic = 1 OR quality = 1)
SELECT * FROM t UNION ALL SELECT * FROM f
""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = table(spark, sf_dir, "labels").select(
        "doc_id", (F.col("quality") * 2 + F.col("toxic")).alias("ord"), F.when(F.col("quality") == 1, "q").otherwise("").alias("value"), F.when(F.col("toxic") == 1, F.col("quality") == 1).alias("is_checked"),
        F.lit(None).cast("int").alias("page"), F.lit(None).cast("struct<x:double,y:double,width:double,height:double>").alias("rect"),
    )
    return documents.coverage(runs(spark, sf_dir), fields).drop("bounds")


@query("SELECT doc_id, line, n FROM (SELECT doc_id, ls[i] AS line, i AS n FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE trim(ls[i]) <> '') QUALIFY row_number() OVER (ORDER BY doc_id, n) <= 30")
def first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).where("trim(line) <> ''")
    return d.orderBy("doc_id", "n").limit(30).select("doc_id", "line", (F.col("n") + 1).cast("long").alias("n"))


# OCR samples: each document's text in lines of 20 words, all of them; a noisy copy of a line is what was read.

_SAMPLE = """
WITH a AS (SELECT doc_id, lang, list_filter(string_split(regexp_replace(coalesce(text, ''), '[\\x00-\\x1F]', '', 'g'), ' '), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, i AS line, lang AS language, array_to_string(list_slice(ws, i * 20 + 1, i * 20 + 20), ' ') AS reference, (doc_id + i) % 100 / 100.0::DOUBLE AS confidence FROM (SELECT *, unnest(range(0, (len(ws) + 19) // 20)) AS i FROM a)),
h AS (SELECT *, translate(reference, 'aeo', '4c0') AS hypothesis FROM s),
m AS (SELECT *, levenshtein(reference, hypothesis) AS ce, length(reference) AS cn, list_filter(string_split(reference, ' '), lambda x: x <> '') AS rw, list_filter(string_split(hypothesis, ' '), lambda x: x <> '') AS hw FROM h),
v AS (SELECT *, list_distinct(list_concat(rw, hw)) AS vc FROM m),
w AS (SELECT *, levenshtein(array_to_string(list_transform(rw, lambda x: chr(40 + list_position(vc, x)::INT)), ''), array_to_string(list_transform(hw, lambda x: chr(40 + list_position(vc, x)::INT)), '')) AS we, len(rw) AS wn FROM v),
z AS (SELECT *, CASE WHEN cn = 0 THEN CASE WHEN ce = 0 THEN 0.0 ELSE 1.0 END ELSE ce::DOUBLE / cn END AS cer, CASE WHEN wn = 0 THEN CASE WHEN we = 0 THEN 0.0 ELSE 1.0 END ELSE we::DOUBLE / wn END AS wer FROM w)
"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x00-\\x1F]", "")
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    d = d.select("doc_id", F.col("lang").alias("language"), F.filter(F.split(t, " "), lambda w: w != "").alias("ws")).where(F.size("ws") > 0)
    # Each line leaves with its own words only.
    lines = F.transform(F.sequence(F.lit(0), F.floor((F.size("ws") - 1) / 20).cast("int")), lambda i: F.struct(i.cast("long").alias("line"), F.array_join(F.slice("ws", i * 20 + 1, 20), " ").alias("reference")))
    d = d.select("doc_id", "language", F.inline(lines))
    d = d.select("doc_id", "line", "language", "reference", ((F.col("doc_id") + F.col("line")) % 100 / F.lit(100.0)).alias("confidence"))
    return d.withColumn("hypothesis", F.translate("reference", "aeo", "4c0"))


@query(_SAMPLE + "SELECT doc_id, line, ce::INT AS char_edits, cn::INT AS chars, we::INT AS word_edits, wn::INT AS words, round(cer, 9) AS cer, round(wer, 9) AS wer FROM z")
def ocr_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.measured(samples(spark, sf_dir), "doc_id", "line").select("doc_id", "line", "char_edits", "chars", "word_edits", "words", F.round("cer", 9).alias("cer"), F.round("wer", 9).alias("wer"))


@query(_SAMPLE + """SELECT CASE WHEN grouping(language) = 1 THEN 'total' ELSE 'language' END AS scope, coalesce(language, '') AS name, count(*) AS samples, round(avg(cer), 9) AS macro_cer, round(avg(wer), 9) AS macro_wer, round(coalesce(sum(ce)::DOUBLE / nullif(sum(cn), 0), 0), 9) AS micro_cer, round(coalesce(sum(we)::DOUBLE / nullif(sum(wn), 0), 0), 9) AS micro_wer FROM z GROUP BY GROUPING SETS ((language), ())""")
def ocr_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ocr.report(samples(spark, sf_dir))
    return r.select("scope", "name", "samples", *(F.round(c, 9).alias(c) for c in ("macro_cer", "macro_wer", "micro_cer", "micro_wer")))


@query(_SAMPLE + "SELECT b.i AS ordinal, b.n AS band, count(z.doc_id) AS samples, round(coalesce(sum(ce)::DOUBLE / nullif(sum(cn), 0), 0), 9) AS micro_cer FROM (VALUES (0, '0.0-0.5', 0.0, 0.5), (1, '0.5-0.7', 0.5, 0.7), (2, '0.7-0.9', 0.7, 0.9), (3, '0.9-1.0', 0.9, 1.01)) b(i, n, lo, hi) LEFT JOIN z ON confidence >= lo::DOUBLE AND confidence < hi::DOUBLE GROUP BY b.i, b.n")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.calibration(samples(spark, sf_dir)).withColumn("micro_cer", F.round("micro_cer", 9))


@query(_SAMPLE + "SELECT doc_id, line, reference AS text, 'Embedded' AS source, NULL::DOUBLE AS confidence FROM h UNION ALL SELECT doc_id, line, hypothesis, 'OcrGenerated', confidence FROM h WHERE confidence >= 0.6::DOUBLE")
def ocr_filter_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    embedded = s.select("doc_id", "line", F.col("reference").alias("text"), F.lit(None).cast("string").alias("source"))
    return ocr.merge(embedded, s.select("doc_id", "line", F.col("hypothesis").alias("text"), "confidence"), 0.6).select("doc_id", "line", "text", "source", "confidence")


@query("""
WITH r AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 4 ELSE 5 END AS level, role AS word, 50.0::DOUBLE + turn % 7 AS c FROM conversations),
l AS (SELECT *, last_value(CASE WHEN level = 4 THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS line FROM r)
SELECT conv_id, line, string_agg(word, ' ' ORDER BY turn) AS text, round(avg(c) / 100, 9) AS confidence, count(*) AS words FROM l WHERE level = 5 AND line IS NOT NULL AND trim(word) <> '' GROUP BY conv_id, line
""")
def ocr_tsv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("ord"), F.when(F.col("turn") % 4 == 0, 4).otherwise(5).alias("level"), F.col("role").alias("word"), (F.lit(50.0) + F.col("turn") % 7).alias("confidence"))
    return ocr.engine_lines(rows, ["conv_id"]).withColumn("confidence", F.round("confidence", 9))


# Trees: region, nation and customer are three levels.

_TREE = """
WITH RECURSIVE n AS (SELECT 'r' || r_regionkey AS id, NULL AS parent, r_name AS name, r_regionkey * 90 AS rotate FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey * 90 END FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name, CASE WHEN c_custkey % 4 = 0 THEN c_custkey * 90 END FROM customer),
t AS (SELECT id, parent, name, rotate, name AS path, 0 AS depth FROM n WHERE parent IS NULL UNION ALL SELECT n.id, n.parent, n.name, coalesce(n.rotate, t.rotate), t.path || '.' || n.name, t.depth + 1 FROM n JOIN t ON n.parent = t.id)
"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    r = table(spark, sf_dir, "region").select(k("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"), (F.col("r_regionkey") * 90).cast("long").alias("rotate"))
    n = table(spark, sf_dir, "nation").select(k("n", "n_nationkey").alias("id"), k("r", "n_regionkey").alias("parent"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_nationkey") * 90).cast("long").alias("rotate"))
    c = table(spark, sf_dir, "customer").select(k("c", "c_custkey").alias("id"), k("n", "c_nationkey").alias("parent"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_custkey") * 90).cast("long").alias("rotate"))
    return r.unionByName(n).unionByName(c)


@query(_TREE + "SELECT id, path, depth FROM t")
def field_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.descend(tree(spark, sf_dir), ["rotate"]).select("id", "path", "depth")


@query(_TREE + "SELECT id, (rotate % 360 + 360) % 360 AS rotation FROM t WHERE depth = 2")
def page_tree_inherit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.descend(tree(spark, sf_dir), ["rotate"]).where("depth = 2").select("id", S.rotation(F.col("rotate")).alias("rotation"))


# Gates and scalars.


@query("SELECT page_id, CASE WHEN strlen(html) < 5 OR NOT contains(substr(html, 1, 900), '<html') THEN 'MissingHeader' WHEN NOT contains(right(html, 1000), '</html>') THEN 'MissingEof' END AS reason FROM pages")
def preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", S.preflight(F.col("html").cast("binary"), head="<html", tail="</html>").alias("reason"))


_MESSAGE = "CASE event_id % 8 WHEN 0 THEN 'Password needed' WHEN 1 THEN 'cannot decrypt' WHEN 2 THEN 'no startxref' WHEN 3 THEN 'Catalog lost' WHEN 4 THEN 'Page Tree broken' WHEN 5 THEN 'truncated' WHEN 6 THEN 'bad ' || event_type ELSE 'cross-reference stream' END"


@query(f"WITH m AS (SELECT event_id, lower({_MESSAGE}) AS m FROM events) SELECT event_id, CASE WHEN m LIKE '%password%' OR m LIKE '%authentication%' THEN 'EncryptedPasswordRequired' WHEN m LIKE '%encrypt%' OR m LIKE '%decrypt%' THEN 'EncryptionUnsupported' WHEN m LIKE '%startxref%' OR m LIKE '%xref%' OR m LIKE '%trailer%' THEN 'XrefUnresolvable' WHEN m LIKE '%catalog%' OR m LIKE '%page tree%' OR m LIKE '%/root%' OR m LIKE '%/pages%' THEN 'CatalogUnreachable' WHEN m LIKE '%endstream%' OR m LIKE '%truncat%' OR m LIKE '%end of input%' THEN 'TruncatedStream' ELSE 'MalformedObject' END AS reason FROM m")
def reject_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", S.rejection_reason(F.expr(_MESSAGE)).alias("reason"))


@query("SELECT doc_id, length(text)::INT AS chars, regexp_replace(substr(text, 1, 40), '[[:cntrl:]]', ' ', 'g') || CASE WHEN length(text) > 40 THEN '…' ELSE '' END AS line, regexp_matches(text, '[^\\x00-\\x1F\\x{FFFD}]') AS meaning, sha256(text) AS input_hash FROM documents")
def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.utf16_length(F.col("text")).alias("chars"), S.console(F.col("text"), 40).alias("line"), S.has_meaning(F.col("text")).alias("meaning"), F.sha2("text", 256).alias("input_hash"))

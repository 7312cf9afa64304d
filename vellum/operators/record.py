"""The analysis record of each document, put together from its facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, StructType

from vellum.functions.scalars import algorithm_name, rejection_reason
from vellum.operators import documents, images, pages, text
from vellum.sources.pdf import ALL, facts, split
from vellum.session import written

SCHEMA_VERSION = "1.2"
_BOX = "struct<x:double,y:double,width:double,height:double>"


def listed(rows: DataFrame, order: str, fields: dict[str, Column], name: str) -> DataFrame:
    """(doc_id, name): a row's fields as a struct, with what it is sorted by."""
    return rows.select("doc_id", F.struct(F.col(order).alias("_o"), F.struct(*(c.alias(k) for k, c in fields.items())).alias("_s")).alias(name))


def in_order(name: str) -> Column:
    """The structs of ``listed`` rows as an array."""
    return F.transform(F.array_sort(F.collect_list(name)), lambda x: x["_s"]).alias(name)


def together(*parts: DataFrame) -> DataFrame:
    """All rows, each with nulls in the other parts' columns: one grouping by doc_id puts a document together, where
    joins of tables that are grouped each by itself would shuffle every one."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


class Facts:
    """The fact tables of a set of documents. The bytes are read once, by the gate, the hash and the kernel: their
    rows are written in the shared folder and every table is a filter over them."""

    def __init__(self, binary: DataFrame, password: str | None = None, threshold: int = images.THRESHOLD, facets: tuple[str, ...] = ALL, hashed: bool = False):
        rows = written(facts(binary, password, facets, hashed), "facts")
        self.sources = split(rows, "source")
        self.rejected = self.sources.where("reason IS NOT NULL").select("doc_id", "reason")
        self.documents, self.pages, self.runs, self.fields = (split(rows, k) for k in ("document", "page", "run", "field"))
        self.xobjects = split(rows, "xobject")
        self.images = images.resolution(split(rows, "image").join(self.pages.select("doc_id", "page", F.col("width").alias("page_width"), F.col("height").alias("page_height")), ["doc_id", "page"]), threshold)
        self.threshold = threshold

    def text(self) -> DataFrame:
        """(doc_id, text) in reading order."""
        return text.plain_text(self.runs)

    def signals(self) -> DataFrame:
        return pages.signals(self.pages, self.runs, self.images, self.fields, self.pages)

    def classified(self) -> DataFrame:
        return pages.decide(self.signals())

    def records(self) -> DataFrame:
        """(doc_id, record): one nested row a document, fields in the order of the JSON form."""
        c = F.col
        img = listed(self.images, "ord", {"page": c("page"), "resourceName": c("name"), "pixelWidth": c("px_w"), "pixelHeight": c("px_h"), "renderedWidthPoints": c("rendered_width"), "renderedHeightPoints": c("rendered_height"), "horizontalDpi": c("horizontal_dpi"), "verticalDpi": c("vertical_dpi"), "effectiveDpi": c("effective_dpi"), "threshold": c("threshold"), "belowThreshold": c("below_threshold"), "filter": images.chain_name(c("filters")), "hasSoftMask": c("has_smask"), "hasMask": c("has_mask"), "isImageMask": c("is_image_mask"), "pageAreaFraction": c("page_area_fraction")}, "images")
        run = listed(self.runs, "run_id", {"page": c("page"), "text": c("text"), "x": c("x"), "y": c("y"), "width": c("width"), "fontSize": c("font_size"), "renderMode": c("render_mode"), "isOcrLayer": c("is_ocr_layer")}, "textRuns")
        field = listed(self.fields, "ord", {"fullyQualifiedName": c("fqn"), "partialName": c("partial"), "label": c("label"), "fieldType": c("field_type"), "value": c("value"), "isChecked": c("is_checked"), "page": c("page"), "rect": c("rect")}, "fields")
        cover = documents.coverage(self.runs, self.fields).withColumn("_n", F.struct(F.when(c("kind") == "text", 0).otherwise(1).alias("k"), F.substring("id", 2, 12).cast("int").alias("n")))
        cover = listed(cover, "_n", {"id": c("id"), "kind": c("kind"), "value": c("value"), "page": c("page"), "bounds": c("bounds")}, "coverage")
        page = listed(self.classified(), "page", {"index": c("page"), "class": c("page_class"), "confidence": c("page_confidence"), "signals": F.struct(*(c(a).alias(b) for a, b in (("text_run_count", "textRunCount"), ("text_coverage_fraction", "textCoverageFraction"), ("has_acro_form_widgets", "hasAcroFormWidgets"), ("widget_count", "widgetCount"), ("is_image_only", "isImageOnly"), ("ocr_layer_present", "ocrLayerPresent"), ("min_image_dpi", "minImageDpi"), ("ruling_line_count", "rulingLineCount"), ("column_alignment_score", "columnAlignmentScore"), ("font_distinct_count", "fontDistinctCount"), ("text_decode_confidence", "textDecodeConfidence"))))}, "pages")
        area = images.largest_area_fraction(self.images, self.pages)
        gone = self.rejected.select("doc_id", "reason", F.lit(None).cast("string").alias("error"))
        d = self.documents.withColumn("reason", F.when(c("error").isNotNull(), rejection_reason(c("error")))).unionByName(gone, allowMissingColumns=True)
        rows = together(img, run, field, cover, page, area, d.select("doc_id", F.struct(*(k for k in d.columns if k != "doc_id")).alias("_d")))
        rows = rows.groupBy("doc_id").agg(*map(in_order, ("images", "textRuns", "fields", "coverage", "pages")), F.max("image_area_fraction").alias("image_area_fraction"), F.collect_list("_d").alias("_d"))
        d = rows.select("*", F.explode("_d").alias("_e")).select("*", "_e.*")
        no = lambda k: F.coalesce(c(k), F.lit(False))
        record = F.struct(
            F.lit(SCHEMA_VERSION).alias("schemaVersion"), F.when(c("reason").isNull(), "Processed").otherwise("Rejected").alias("status"),
            F.when(c("reason").isNotNull(), F.struct(c("reason"), c("error").alias("detail"))).alias("rejection"), F.coalesce("page_count", F.lit(0)).alias("pageCount"),
            F.coalesce("image_area_fraction", F.lit(0.0)).alias("imageAreaFraction"),
            F.struct(no("is_encrypted").alias("isEncrypted"), F.coalesce("handler_supported", F.lit(True)).alias("handlerSupported"), algorithm_name(F.coalesce("algorithm", F.lit("None"))).alias("algorithm"), F.coalesce("revision", F.lit(0)).alias("revision"), F.coalesce("authentication", F.lit("NotRequired")).alias("authentication"), (no("is_encrypted") & no("metadata_encrypted")).alias("metadataEncrypted"), F.coalesce("permissions", F.lit(0)).alias("permissions")).alias("security"),
            "images", "textRuns", F.struct(no("has_acro_form").alias("hasAcroForm"), no("has_xfa").alias("hasXfa"), "fields").alias("form"), "coverage", "pages",
        )
        return d.select("doc_id", record.alias("record"))

    def outcomes(self) -> DataFrame:
        """The ledger's row of each document, without its hashes."""
        c = F.col
        seen = ~c("is_ocr_layer")
        run = self.runs.select("doc_id", F.when(seen, F.length(F.encode("text", "UTF-16BE")) / 2).otherwise(0).alias("chars"), c("is_ocr_layer").alias("ocr"))
        img = self.images.select("doc_id", F.lit(1).alias("n"), "below_threshold", F.when(c("effective_dpi") > 0, F.struct("ord", "effective_dpi")).alias("dpi"))
        field = self.fields.select("doc_id", F.lit(1).alias("field"))
        area = images.largest_area_fraction(self.images, self.pages)
        d = self.documents.withColumn("rejection", F.when(c("error").isNotNull(), rejection_reason(c("error"))))
        d = d.unionByName(self.rejected.withColumnRenamed("reason", "rejection"), allowMissingColumns=True)
        rows = together(run, img, field, area, d.select("doc_id", F.struct(*(k for k in d.columns if k != "doc_id")).alias("_d")))
        rows = rows.groupBy("doc_id").agg(
            F.sum("chars").alias("chars"), F.bool_or("ocr").alias("ocr"), F.count("n").alias("n"), F.count_if("below_threshold").alias("below_threshold_count"), F.transform(F.array_sort(F.collect_list("dpi")), lambda s: s["effective_dpi"]).alias("effective_dpis"),
            F.count("field").alias("fields"), F.max("image_area_fraction").alias("image_area_fraction"), F.collect_list("_d").alias("_d"),
        )
        d = rows.select("*", F.explode("_d").alias("_e")).select("*", "_e.*")
        zero, no, bad = F.lit(0), (lambda k: F.coalesce(c(k), F.lit(False))), c("rejection").isNotNull()
        unreadable = no("is_encrypted") & (c("authentication") == "Failed")
        unreadable = F.coalesce(unreadable, F.lit(False))
        fields = F.when(no("has_acro_form"), F.coalesce("fields", zero)).otherwise(0)
        return d.select(
            "doc_id", F.when(bad, "Rejected").otherwise("Processed").alias("status"),
            documents.category(bad, unreadable, fields, F.coalesce("image_area_fraction", F.lit(0.0)), no("ocr"), F.coalesce("chars", F.lit(0.0)), F.coalesce("n", zero)).alias("category"),
            F.coalesce("page_count", zero).cast("int").alias("page_count"), no("ocr").alias("ocr_present"), (fields > 0).alias("form_present"), F.coalesce("algorithm", F.lit("None")).alias("encryption_algorithm"), no("is_encrypted").alias("encrypted"), unreadable.alias("encrypted_unreadable"),
            F.coalesce("rejection", F.lit("None")).alias("rejection"), F.lit(self.threshold).alias("threshold"), F.coalesce("below_threshold_count", zero).cast("long").alias("below_threshold_count"), F.coalesce("effective_dpis", F.array().cast("array<double>")).alias("effective_dpis"),
        )


def finite(c: Column, kind: DataType) -> Column:
    """The value with 0 for each number in it that JSON has no sign for."""
    if isinstance(kind, (DoubleType, FloatType)):
        return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(c)
    if isinstance(kind, ArrayType) and _has_floats(kind):
        return F.transform(c, lambda x: finite(x, kind.elementType))
    if isinstance(kind, StructType) and _has_floats(kind):
        return F.when(c.isNotNull(), F.struct(*(finite(c[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    return c


def _has_floats(kind: DataType) -> bool:
    text = kind.simpleString()
    return "double" in text or "float" in text


def to_json(records: DataFrame) -> DataFrame:
    """(doc_id, json): nulls stay; NaN and infinite numbers are 0."""
    record = finite(F.col("record"), records.schema["record"].dataType)
    return records.select("doc_id", F.to_json(record, {"ignoreNullFields": "false"}).alias("json"))

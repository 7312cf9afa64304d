"""Document categories, page roll-up and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: In the order that results have.
CATEGORIES = ["DigitalText", "ScannedImageOnly", "ScannedWithOcr", "Mixed", "FormBased", "EncryptedUnreadable", "Rejected"]
IMAGE_SHARE = 0.8
LEAST_CHARACTERS = 24
_FROM_PAGE = {"DigitalText": "DigitalText", "TableOrComplexLayout": "DigitalText", "ScannedImageOnly": "ScannedImageOnly", "ScannedWithOcr": "ScannedWithOcr", "Mixed": "Mixed"}


def category(rejected: Column, unreadable: Column, fields: Column, image_share: Column, ocr: Column, characters: Column, images: Column) -> Column:
    """The category of one document; rules in order of precedence."""
    text = characters >= LEAST_CHARACTERS
    full = image_share >= IMAGE_SHARE
    return (
        F.when(rejected, "Rejected").when(unreadable, "EncryptedUnreadable").when(fields > 0, "FormBased")
        .when(full & ocr, "ScannedWithOcr").when(full & text, "Mixed").when(full, "ScannedImageOnly")
        .when(text, "DigitalText").when(images > 0, "ScannedImageOnly").otherwise("DigitalText")
    )


def roll_up(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, category) from page classes: any form page makes a form; empty pages don't count; one category
    is the document's, several are Mixed, none is DigitalText."""
    mapped = None
    for p, d in _FROM_PAGE.items():
        mapped = F.when(F.col("page_class") == p, d) if mapped is None else mapped.when(F.col("page_class") == p, d)
    low, high = F.min(mapped), F.max(mapped)
    kind = F.when(F.bool_or(F.col("page_class") == "FormPage"), "FormBased").when(low.isNull(), "DigitalText").when(low == high, low).otherwise("Mixed")
    return pages.groupBy(key).agg(kind.alias("category"))


def coverage(runs: DataFrame, fields: DataFrame) -> DataFrame:
    """(doc_id, id, kind, value, page, bounds): all text runs as t0, t1, ..., then the fields that say
    something as f0, f1, ...: a checkbox's state, or a value that is not empty."""
    from pyspark.sql import Window as W

    number = lambda order: (F.row_number().over(W.partitionBy("doc_id").orderBy(order)) - 1).cast("string")
    rect = lambda x, y, w, h: F.struct(F.coalesce(x, F.lit(0.0)).alias("x"), F.coalesce(y, F.lit(0.0)).alias("y"), F.coalesce(w, F.lit(0.0)).alias("width"), F.coalesce(h, F.lit(0.0)).alias("height"))
    text = runs.select("doc_id", F.concat(F.lit("t"), number("run_id")).alias("id"), F.lit("text").alias("kind"), F.col("text").alias("value"), "page", rect(F.col("x"), F.col("y"), F.col("width"), F.col("font_size")).alias("bounds"))
    checked = F.col("is_checked").isNotNull()
    said = fields.where(checked | (F.coalesce("value", F.lit("")) != ""))
    state = F.when(checked, F.when(F.col("is_checked"), "true").otherwise("false")).otherwise(F.col("value"))
    field = said.select("doc_id", F.concat(F.lit("f"), number("ord")).alias("id"), F.when(checked, "checkbox").otherwise("field").alias("kind"), state.alias("value"), F.coalesce("page", F.lit(-1)).alias("page"), rect(*(F.col(f"rect.{k}") for k in ("x", "y", "width", "height"))).alias("bounds"))
    return text.unionByName(field)

"""Page signals and the page decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLASSES = ["DigitalText", "ScannedImageOnly", "ScannedWithOcr", "FormPage", "TableOrComplexLayout", "Mixed", "Empty"]
BUCKET = 3.0


def column_score(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Adds up how many runs begin at abscissas where three or more do, as a share of all; 0 for fewer than
    six runs or fewer than two such abscissas. Two levels of grouping, both with partial aggregates."""
    bucket = F.round(F.col("x") / BUCKET).cast("long")
    lists = runs.select(*keys, bucket.alias("_bucket")).groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    strong = F.count_if(F.col("_n") >= 3)
    total, held = F.sum("_n"), F.coalesce(F.sum(F.when(F.col("_n") >= 3, F.col("_n"))), F.lit(0))
    score = F.when((total < 6) | (strong < 2), F.lit(0.0)).otherwise(F.round(held / total, 4))
    return lists.groupBy(*keys).agg(score.alias("column_alignment_score"))


def decode_confidence(authoritative: Column, fallback: Column, unmapped: Column) -> Column:
    """Trust in decoded characters: a fallback counts a quarter; 1 where there are none."""
    total = authoritative + fallback + unmapped
    return F.when(total > 0, F.round((authoritative + 0.25 * fallback) / F.nullif(total, F.lit(0)), 4)).otherwise(F.lit(1.0))


def signals(pages: DataFrame, runs: DataFrame, images: DataFrame, fields: DataFrame, structure: DataFrame) -> DataFrame:
    """One row a page with all signals. Each fact table is grouped by page before it is joined, so that every
    join is one to one on (doc_id, page). ``images`` has effective_dpi and page_area_fraction."""
    key = ["doc_id", "page"]
    seen = runs.where("NOT is_ocr_layer")
    text = seen.groupBy(*key).agg(
        F.count("*").alias("text_run_count"), F.sum(F.abs("width") * F.abs("font_size")).alias("_covered"),
        F.sum("authoritative").alias("_a"), F.sum("fallback").alias("_f"), F.sum("unmapped").alias("_u"),
    )
    ocr = runs.groupBy(*key).agg(F.bool_or("is_ocr_layer").alias("ocr_layer_present"))
    image = images.groupBy(*key).agg(F.max("page_area_fraction").alias("max_image_fraction"), F.min(F.when(F.col("effective_dpi") > 0, F.col("effective_dpi"))).alias("min_image_dpi"), F.count("*").alias("image_count"))
    widget = fields.where("page IS NOT NULL AND page >= 0").groupBy(*key).agg(F.count("*").alias("widget_count"))
    out = pages.select(*key, "width", "height").join(text, key, "left").join(ocr, key, "left").join(image, key, "left").join(widget, key, "left")
    out = out.join(structure.select(*key, "ruling_line_count", "font_distinct_count"), key, "left").join(column_score(seen, key), key, "left")
    zero, nought = F.lit(0).cast("long"), F.lit(0.0)
    area = F.col("width") * F.col("height")
    c = lambda name, default: F.coalesce(F.col(name), default)
    return out.select(
        *key, c("text_run_count", zero).alias("text_run_count"),
        F.when(area > 0, F.round(F.least(F.lit(1.0), c("_covered", nought) / F.nullif(area, nought)), 4)).otherwise(nought).alias("text_coverage_fraction"),
        (c("widget_count", zero) > 0).alias("has_acro_form_widgets"), c("widget_count", zero).alias("widget_count"),
        (c("max_image_fraction", nought) >= 0.8).alias("is_image_only"), c("ocr_layer_present", F.lit(False)).alias("ocr_layer_present"),
        F.round(c("min_image_dpi", nought), 1).alias("min_image_dpi"), c("image_count", zero).alias("image_count"),
        c("ruling_line_count", zero).cast("long").alias("ruling_line_count"), c("column_alignment_score", nought).alias("column_alignment_score"),
        c("font_distinct_count", zero).cast("long").alias("font_distinct_count"),
        decode_confidence(c("_a", zero), c("_f", zero), c("_u", zero)).alias("text_decode_confidence"),
    )


def decide(s: DataFrame) -> DataFrame:
    """Adds page_class and page_confidence: the first rule that holds."""
    runs, cover, images, rules = F.col("text_run_count"), F.col("text_coverage_fraction"), F.col("image_count"), F.col("ruling_line_count")
    only, ocr, widgets = F.col("is_image_only"), F.col("ocr_layer_present"), F.col("has_acro_form_widgets")
    text = (runs >= 3) | (cover >= 0.01)
    table = (rules >= 12) | (F.col("column_alignment_score") >= 0.6)
    order = [
        (only & text, "Mixed", F.lit(0.7)), (only & ocr, "ScannedWithOcr", F.lit(0.9)), (only, "ScannedImageOnly", F.lit(0.9)),
        (widgets & table, "Mixed", F.lit(0.7)), (widgets, "FormPage", F.lit(0.85)), (table & text, "TableOrComplexLayout", F.lit(0.7)),
        (text, "DigitalText", F.when(cover < 0.02, 0.55).otherwise(0.9)), ((runs == 0) & (images == 0) & (rules == 0), "Empty", F.lit(1.0)),
        (images > 0, "ScannedImageOnly", F.lit(0.4)), (rules > 0, "TableOrComplexLayout", F.lit(0.5)), ((runs > 0) & (cover > 0), "DigitalText", F.lit(0.4)),
    ]
    name, sure = F.when(order[0][0], order[0][1]), F.when(order[0][0], order[0][2])
    for test, n, v in order[1:]:
        name, sure = name.when(test, n), sure.when(test, v)
    return s.withColumns({"page_class": name.otherwise("Empty"), "page_confidence": sure.otherwise(F.lit(0.4))})

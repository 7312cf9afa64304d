"""Image placements: effective resolution, names of filter chains, area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 150


def resolution(placements: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Adds rendered size, DPI on both axes, effective DPI, whether it is below the threshold and the share
    of the page that each placement covers. Needs px_w, px_h, the matrix a b c d, page_width, page_height."""
    w, h = F.hypot("a", "b"), F.hypot("c", "d")
    dpi = lambda px, size: F.when(size > 0, F.col(px) * 72.0 / F.nullif(size, F.lit(0.0))).otherwise(F.lit(0.0))
    out = placements.withColumns({"rendered_width": w, "rendered_height": h})
    out = out.withColumns({"horizontal_dpi": dpi("px_w", F.col("rendered_width")), "vertical_dpi": dpi("px_h", F.col("rendered_height"))})
    x, y = F.col("horizontal_dpi"), F.col("vertical_dpi")
    out = out.withColumn("effective_dpi", F.when((x > 0) & (y > 0), F.least(x, y)).otherwise(F.greatest(x, y)))
    area = F.col("page_width") * F.col("page_height")
    return out.withColumns({
        "threshold": F.lit(threshold),
        "below_threshold": (F.col("effective_dpi") > 0) & (F.col("effective_dpi") < threshold),
        "page_area_fraction": F.when(area > 0, F.least(F.lit(1.0), F.col("rendered_width") * F.col("rendered_height") / F.nullif(area, F.lit(0.0)))).otherwise(F.lit(0.0)),
    })


def chain_name(filters: Column) -> Column:
    """All filters of a chain, joined."""
    return F.array_join(filters, "+")


def codec(filters: Column) -> Column:
    """The last filter of a chain: the one that makes pixels."""
    return F.when(F.size(filters) > 0, F.element_at(filters, -1))


def largest_area_fraction(placements: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, image_area_fraction): per page the sum of the images' areas by the page's, 1 at most; per
    document the largest. Pages without area count as 0; documents without images as 0 too."""
    area = F.hypot("a", "b") * F.hypot("c", "d")
    sums = placements.groupBy("doc_id", "page").agg(F.sum(F.when(area > 0, area).otherwise(0.0)).alias("_area"))
    box = F.col("width") * F.col("height")
    share = F.when(box > 0, F.least(F.lit(1.0), F.coalesce(F.col("_area"), F.lit(0.0)) / F.nullif(box, F.lit(0.0)))).otherwise(F.lit(0.0))
    return pages.select("doc_id", "page", "width", "height").join(sums, ["doc_id", "page"], "left").groupBy("doc_id").agg(F.max(share).alias("image_area_fraction"))

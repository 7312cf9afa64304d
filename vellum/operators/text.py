"""Reading-order text from positioned runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_BLANK = r"(?U)\s"


def plain_text(runs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, text): pages in order; lines by rounded ordinate from the top; in a line by abscissa, ties in
    the runs' order. Between two runs stands a blank if the gap is more than half the font's space and neither
    side has white space. A line ends in a line feed, a page in one more. One shuffle, by key."""
    keys = keys or ["doc_id"]
    line = [*keys, "page", "_line"]
    r = runs.withColumn("_line", F.rint("y"))
    w = W.partitionBy(*line).orderBy("x", "run_id")
    before = lambda c: F.lag(c).over(w)
    space = F.when(before(F.col("space_width_em")) > 0, before(F.col("space_width_em"))).otherwise(F.lit(0.25))
    size = F.when(before(F.col("font_size")) > 0, before(F.col("font_size"))).when(F.col("font_size") > 0, F.col("font_size")).otherwise(F.lit(1.0))
    gap = F.col("x") - before(F.col("x") + F.col("width"))
    open_ = ~(before(F.col("text")).rlike(_BLANK + "$") | F.col("text").rlike("^" + _BLANK))
    joined = F.when(before(F.col("text")).isNotNull() & open_ & (gap > space * size * 0.5), F.lit(" ")).otherwise(F.lit(""))
    r = r.withColumn("_piece", F.concat(joined, F.col("text")))
    lines = r.groupBy(*line).agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "run_id", "_piece"))), lambda s: s["_piece"]), ""), F.lit("\n")).alias("_t"))
    pages = lines.groupBy(*keys, "page").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_line")).alias("o"), "_t"))), lambda s: s["_t"]), ""), F.lit("\n")).alias("_p"))
    return pages.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "_p"))), lambda s: s["_p"]), "").alias("text"))

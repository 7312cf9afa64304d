"""Ledger, resume and the corpus aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions.scalars import half_even, percent
from vellum.operators.documents import CATEGORIES

ALGORITHMS = ["None", "Rc4", "Aes128", "Aes256", "Unknown"]
REASONS = ["None", "MissingHeader", "MissingEof", "XrefUnresolvable", "CatalogUnreachable", "EncryptedPasswordRequired", "EncryptionUnsupported", "TruncatedStream", "MalformedObject"]
DPI_BUCKETS = ["<150", "150-299", "300-599", ">=600"]


def last_wins(ledger: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key."""
    rest = [c for c in ledger.columns if c != key]
    newest = ledger.groupBy(key).agg(F.max_by(F.struct(*(F.col(f"`{c}`") for c in rest)), order).alias("_newest"))
    return newest.select(*(F.col(f"`{c}`") if c == key else F.col(f"_newest.`{c}`") for c in ledger.columns))


def to_do(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files that the ledger doesn't have with the same content."""
    return files.join(ledger.select("id", "input_hash"), ["id", "input_hash"], "left_anti")


def reusable(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """The ledger's rows of files that have not changed."""
    return ledger.join(files.select("id", "input_hash"), ["id", "input_hash"], "left_semi")


def counts(rows: DataFrame, column: str, values: list[str], whole: Column | None = None) -> DataFrame:
    """(name, count, percent) in the order of ``values``, without those that don't occur; per cent of all."""
    n = rows.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("count"))
    total = F.sum("count").over(W.partitionBy()) if whole is None else whole
    order = F.array_position(F.array(*map(F.lit, values)), F.col("name"))
    return n.withColumn("percent", percent(F.col("count"), total)).where(order > 0).withColumn("ordinal", order.cast("int"))


def ranked(values: DataFrame, c: str, *counts: Column) -> DataFrame:
    """A row for each value of ``c`` to one place, half-even: its number of rows ``n``, theirs and those of all lesser
    values ``up_to``, all rows ``whole``, and ``counts``. Rounding keeps the order, so that the value of any rank is
    among these. Only different values meet in one place, not the rows: tenths of a unit, however many there are."""
    g = values.groupBy(half_even(F.col(c), 1).alias("value")).agg(F.count("*").alias("n"), *counts)
    return g.withColumns({"up_to": F.sum("n").over(W.orderBy("value")), "whole": F.sum("n").over(W.partitionBy())})


def nearest_rank(percentile: int) -> Column:
    """Of ``ranked`` rows: the value of rank ceil(n percentile / 100), in whole numbers; 0 of none."""
    return F.coalesce(F.min(F.when(F.col("up_to") * 100 >= F.col("whole") * percentile, F.col("value"))), F.lit(0.0))


def _total(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0).cast("long"))


def _figures() -> list[Column]:
    """Of ``ranked`` rows: how many images have a resolution, the least, median and 95th per cent."""
    return [_total("n").alias("images"), F.coalesce(F.min("value"), F.lit(0.0)).alias("min_dpi"), nearest_rank(50).alias("median_dpi"), nearest_rank(95).alias("p95_dpi")]


def dpi_statistics(images: DataFrame, c: str = "effective_dpi") -> DataFrame:
    """One row: how many images have a resolution, the least, median and 95th per cent, how many are below."""
    r = ranked(images.where(F.col(c) > 0), c, F.count_if("below_threshold").alias("_below"))
    return r.agg(*_figures(), _total("_below").alias("below"), percent(_total("_below"), _total("n")).alias("below_percent"))


def dpi_histogram(images: DataFrame, c: str = "effective_dpi") -> DataFrame:
    """Four rows, one for each bucket, also if it is empty."""
    v = F.col(c)
    tests = [v < 150, (v >= 150) & (v < 300), (v >= 300) & (v < 600), v >= 600]
    one = images.where(v > 0).agg(*(F.count_if(t).alias(f"_{i}") for i, t in enumerate(tests)))
    rows = F.array(*(F.struct(F.lit(i).alias("ordinal"), F.lit(b).alias("bucket"), F.col(f"_{i}").alias("count")) for i, b in enumerate(DPI_BUCKETS)))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def aggregate(outcomes: DataFrame) -> DataFrame:
    """One row of a corpus, without names or texts: counts and shares by category, algorithm and rejection,
    resolution figures and shares of documents with forms and text layers. ``outcomes`` is the ledger's table.
    All figures but the resolution's come from one partial and final hash aggregate."""
    rejected, encrypted = F.col("status") == "Rejected", F.col("encrypted")
    total, done = F.count("*"), F.count_if(~rejected)
    some = lambda test: F.count_if(test)

    def by(column: str, values: list[str], test: Column, whole: Column) -> Column:
        """Array of (name, count, percent) in enum order, of those that occur."""
        rows = F.array(*(F.struct(F.lit(v).alias("name"), some(test & (F.col(column) == v)).alias("count"), percent(some(test & (F.col(column) == v)), whole).alias("percent")) for v in values))
        return F.filter(rows, lambda r: r["count"] > 0)

    head = outcomes.agg(
        total.alias("total"), done.alias("processed"), some(rejected).alias("rejected"), some(F.col("encrypted_unreadable")).alias("encrypted_unreadable"),
        by("category", CATEGORIES, F.lit(True), total).alias("categories"), by("encryption_algorithm", ALGORITHMS[1:], encrypted, total).alias("algorithms"),
        by("rejection", REASONS[1:], rejected, total).alias("rejections"), percent(some(encrypted), total).alias("encrypted_percent"),
        percent(some(~rejected & F.col("ocr_present")), done).alias("ocr_percent"), percent(some(~rejected & F.col("form_present")), done).alias("form_percent"),
        F.coalesce(F.max(F.when(F.col("threshold") > 0, F.col("threshold"))), F.lit(150)).alias("threshold"),
        F.coalesce(F.sum("below_threshold_count"), F.lit(0)).cast("long").alias("images_below"), F.coalesce(F.sum("page_count"), F.lit(0)).cast("long").alias("pages"),
    )
    images = outcomes.select(F.explode("effective_dpis").alias("effective_dpi")).where("effective_dpi > 0")
    v = F.col("effective_dpi")
    tests = [v < 150, (v >= 150) & (v < 300), (v >= 300) & (v < 600), v >= 600]
    dpi = ranked(images, "effective_dpi", *(some(t).alias(f"_{i}") for i, t in enumerate(tests)))
    dpi = dpi.agg(*_figures(), F.array(*(F.struct(F.lit(b).alias("bucket"), _total(f"_{i}").alias("count")) for i, b in enumerate(DPI_BUCKETS))).alias("histogram"))
    return head.crossJoin(dpi).withColumn("images_below_percent", percent(F.col("images_below"), F.col("images")))

"""OCR: accuracy reports, confidence filters, merged runs, lines of an engine's table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from vellum.functions.scalars import rate
from vellum.session import free_name, ship

BANDS = [("0.0-0.5", 0.0, 0.5), ("0.5-0.7", 0.5, 0.7), ("0.7-0.9", 0.7, 0.9), ("0.9-1.0", 0.9, 1.01)]


def measured(samples: DataFrame, *keep: str) -> DataFrame:
    """Adds distances, lengths and rates of characters and words to all columns, or to those to ``keep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from vellum.kernel.distances import measures

        for b in batches:
            *kept, r, h = b.columns
            found = [pa.array(x, pa.int32()) for x in measures(r.to_pylist(), h.to_pylist())]
            yield pa.RecordBatch.from_arrays([*kept, *found], names)

    ship(samples.sparkSession)
    rest = samples.select(*(F.col(f"`{c}`") for c in keep or samples.columns))
    r = free_name("_r", rest.columns)
    h = free_name("_h", [*rest.columns, r])
    text = lambda c, name: F.make_valid_utf8(F.coalesce(c, F.lit(""))).alias(name)
    schema = StructType([*rest.schema.fields, *(StructField(c, IntegerType()) for c in ("char_edits", "chars", "word_edits", "words"))])
    names = schema.names
    rows = samples.select(*(F.col(f"`{c}`") for c in rest.columns), text(F.col("reference"), r), text(F.col("hypothesis"), h))
    out = rows.mapInArrow(run, schema)
    return out.withColumns({"cer": rate(F.col("char_edits"), F.col("chars")), "wer": rate(F.col("word_edits"), F.col("words"))})


def _figures() -> list[Column]:
    micro = lambda d, n: F.coalesce(F.sum(d) / F.nullif(F.sum(n), F.lit(0)), F.lit(0.0))
    return [F.count("*").alias("samples"), F.avg("cer").alias("macro_cer"), F.avg("wer").alias("macro_wer"), micro("char_edits", "chars").alias("micro_cer"), micro("word_edits", F.when(F.col("word_edits").isNotNull(), F.col("words"))).alias("micro_wer")]


def report(samples: DataFrame) -> DataFrame:
    """(scope, name, figures ...): of all samples and of each language, in one pass of grouping sets. A sample
    without a word distance is in none of the figures of words."""
    m = measured(samples, "language").withColumn("language", F.coalesce("language", F.lit("")))
    g = m.groupingSets([["language"], []], "language").agg(F.grouping("language").alias("_all"), *_figures())
    return g.select(F.when(F.col("_all") == 1, "total").otherwise("language").alias("scope"), F.coalesce("language", F.lit("")).alias("name"), *(c for c in g.columns if c not in ("language", "_all")))


def calibration(samples: DataFrame) -> DataFrame:
    """Each confidence band with its samples' micro error rate: a range join to four bands, also of none."""
    spark = samples.sparkSession
    bands = spark.createDataFrame([(i, *b) for i, b in enumerate(BANDS)], "ordinal int, band string, low double, high double")
    m = measured(samples, "confidence").select("confidence", "char_edits", "chars")
    # Four rows; every sample meets them on its own side of the shuffle.
    joined = m.join(F.broadcast(bands), (F.col("confidence") >= F.col("low")) & (F.col("confidence") < F.col("high")))
    sums = joined.groupBy("ordinal").agg(F.count("*").alias("n"), F.sum("char_edits").alias("_e"), F.sum("chars").alias("_c"))
    return bands.join(sums, "ordinal", "left").select("ordinal", "band", F.coalesce("n", F.lit(0)).cast("long").alias("samples"), F.coalesce(F.col("_e") / F.nullif(F.col("_c"), F.lit(0)), F.lit(0.0)).alias("micro_cer"))


def merge(runs: DataFrame, lines: DataFrame, least: float = 0.0) -> DataFrame:
    """Embedded runs and the engine's lines of enough confidence, marked by their source."""
    return runs.withColumn("source", F.coalesce("source", F.lit("Embedded"))).unionByName(lines.where(F.col("confidence") >= least).withColumn("source", F.lit("OcrGenerated")), allowMissingColumns=True)


def engine_lines(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of an engine's word table: a row of level 4 opens a line, rows of level 5 are its words until
    the next; a line's confidence is its words' mean by 100. Words before any line have none."""
    w = W.partitionBy(*keys).orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    line = F.last(F.when(F.col("level") == 4, F.col("ord")), ignorenulls=True).over(w)
    words = rows.withColumn("line", line).where("level = 5 AND line IS NOT NULL AND trim(word) <> ''")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "word"))), lambda s: s["word"]), " ")
    return words.groupBy(*keys, "line").agg(text.alias("text"), (F.avg("confidence") / 100).alias("confidence"), F.count("*").alias("words"))

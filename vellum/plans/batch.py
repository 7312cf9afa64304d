"""Corpus runs: incremental, resumable, with a ledger, an aggregate and a JSON record a file; and the same as
a stream of new files."""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import corpus
from vellum.operators.record import Facts, to_json
from vellum.session import ship, written
from vellum.sources import pdf

LEDGER = "id string, input_hash string, status string, category string, page_count int, ocr_present boolean, form_present boolean, encryption_algorithm string, encrypted boolean, encrypted_unreadable boolean, rejection string, threshold int, below_threshold_count long, effective_dpis array<double>, seq long"


@dataclass
class Options:
    """``output`` is a folder that all executors share. ``records``: also write the JSON records, as one table;
    ``perfile``: besides, as a file for each document."""

    input: str
    output: str
    threshold: int = 150
    password: str | None = None
    records: bool = True
    perfile: bool = False


def ledger(spark: SparkSession, output: str) -> DataFrame:
    """The newest row of each file; an empty table before the first run."""
    try:
        rows = spark.read.schema(LEDGER).parquet(f"{output}/ledger")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], LEDGER)
    return corpus.last_wins(rows, "id", "seq")


def process(files: DataFrame, options: Options, seq: int, hashes: DataFrame | None = None) -> DataFrame:
    """Runs the documents of (path, content) and appends to ledger and records. ``hashes`` are those known
    already, as (id, input_hash); without them each file is hashed in the pass that reads it. Returns them."""
    facts = Facts(files.select(F.sha2("path", 256).alias("doc_id"), "content"), options.password, options.threshold, hashed=hashes is None)
    if hashes is None:
        hashes = facts.sources.select(F.col("doc_id").alias("id"), "input_hash")
    rows = hashes.join(facts.outcomes(), F.col("id") == F.col("doc_id")).drop("doc_id").withColumn("seq", F.lit(seq).cast("long"))
    rows.select([c.strip().split(" ")[0] for c in LEDGER.split(", ")]).write.mode("append").parquet(f"{options.output}/ledger")
    if options.records:
        json = to_json(facts.records())
        json.write.mode("append").parquet(f"{options.output}/records")
        if options.perfile:
            export(json, f"{options.output}/perfile")
    return hashes


def export(records: DataFrame, folder: str) -> None:
    """A file ``<doc_id>.json`` for each row of (doc_id, json), written by the executors; a file appears whole, and
    a task that is run again writes the same. Ids are file names: those of a run are hexadecimal hashes."""

    def write(rows) -> None:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        for r in rows:
            put(fs, f"{root}/{r.doc_id}.json", r.json)

    ship(records.sparkSession)
    records.foreachPartition(write)


def filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def put(fs, path: str, text: str) -> None:
    temporary = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(temporary) as f:
        f.write(text.encode())
    fs.move(temporary, path)


def run(spark: SparkSession, options: Options) -> DataFrame:
    """One run: files that the ledger has with the same content are skipped, all others are processed. Returns
    the aggregate of all files that are there now, one row, also written as JSON: a line in ``aggregate`` and
    indented in aggregate.json.

    The first run reads each file once. Later ones hash all files, join the ledger by (id, hash), without contents,
    and read the bytes of files that are left once more. Their paths go through the driver, which holds the list
    of all files anyway to plan the scan."""
    ship(spark)
    files = pdf.files(spark, options.input)
    known = ledger(spark, options.output)
    seq = known.agg(F.max("seq")).collect()[0][0]
    if seq is None:
        there = process(files, options, 1)
    else:
        there = resume(files, known, options, seq + 1)
    now = corpus.reusable(there, ledger(spark, options.output)).drop("seq")
    total = written(corpus.aggregate(now).withColumn("schemaVersion", F.lit("1.0")), "aggregate")
    line = total.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    line.coalesce(1).write.mode("overwrite").text(f"{options.output}/aggregate")
    fs, root = filesystem(options.output)
    put(fs, f"{root}/aggregate.json", json.dumps(json.loads(line.first().value), indent=2, ensure_ascii=False))
    return total


def resume(files: DataFrame, known: DataFrame, options: Options, seq: int) -> DataFrame:
    """Processes the files that the ledger doesn't have with this content. Returns all files' (id, input_hash)."""
    listing = written(files.select("path", F.sha2("path", 256).alias("id"), F.sha2("content", 256).alias("input_hash")), "listing")
    todo = written(corpus.to_do(listing, known), "todo")
    if paths := [r.path for r in todo.select("path").toLocalIterator()]:
        chosen = files.sparkSession.read.format("binaryFile").load([escaped(p) for p in paths])
        process(chosen, options, seq, todo.select("id", "input_hash"))
    return listing.select("id", "input_hash")


def escaped(path: str) -> str:
    """A path whose signs of a pattern stand for themselves."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def tsv(rows: DataFrame) -> DataFrame:
    """The ledger as lines of 14 columns: booleans as 0 and 1, resolutions rounded and joined by commas."""
    flag = lambda k: F.col(k).cast("int").cast("string")
    dpis = F.array_join(F.transform("effective_dpis", lambda v: F.rint(v).cast("int").cast("string")), ",")
    text = lambda k: F.col(k).cast("string")
    return rows.select(F.concat_ws("\t", text("id"), text("input_hash"), text("status"), text("category"), text("page_count"), flag("ocr_present"), flag("form_present"), text("encryption_algorithm"), flag("encrypted"), flag("encrypted_unreadable"), text("rejection"), text("threshold"), text("below_threshold_count"), dpis).alias("value"))


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Ledger lines; those of fewer than 14 columns go, numbers that can't be read are 0, the last of an id
    counts. Line order is the file's, so a ledger is one file."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("seq"))
    p = F.split("value", "\t")
    rows = lines.where(F.size(p) >= 14)
    num = lambda i, kind: F.coalesce(p[i].try_cast(kind), F.lit(0).cast(kind))
    one_of = lambda i, values: F.when(p[i].isin(values), p[i]).otherwise(values[0])
    from vellum.operators.documents import CATEGORIES

    rows = rows.select(
        p[0].alias("id"), p[1].alias("input_hash"), one_of(2, ["Processed", "Rejected"]).alias("status"), one_of(3, CATEGORIES).alias("category"), num(4, "int").alias("page_count"), (p[5] == "1").alias("ocr_present"), (p[6] == "1").alias("form_present"),
        one_of(7, corpus.ALGORITHMS).alias("encryption_algorithm"), (p[8] == "1").alias("encrypted"), (p[9] == "1").alias("encrypted_unreadable"), one_of(10, corpus.REASONS).alias("rejection"), num(11, "int").alias("threshold"), num(12, "long").alias("below_threshold_count"),
        F.filter(F.transform(F.split(p[13], ","), lambda v: v.try_cast("double")), lambda v: v.isNotNull()).alias("effective_dpis"), "seq",
    )
    return corpus.last_wins(rows, "id", "seq")

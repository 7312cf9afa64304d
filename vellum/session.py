"""Session helpers: worker import path and memory, the shared folder and tables written to cut lineage."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
_written: list[tuple[SparkSession, str]] = []


#: What the session leaves open: small Arrow batches, since texts can be long.
_ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, and keep them small: large arrays
    go back to the system when they are freed, and batches are small where the session doesn't say otherwise."""
    env = spark.sparkContext.environment
    paths = [p for p in (env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        paths = [ROOT, *paths]
    env["PYTHONPATH"] = os.pathsep.join(paths)
    env.setdefault("MALLOC_MMAP_THRESHOLD_", str(1 << 20))
    env.setdefault("MALLOC_ARENA_MAX", "2")
    for key, value in _ARROW.items():
        if not spark.sparkContext.getConf().contains(key):
            spark.conf.set(key, value)
    return spark


#: The cached functions whose tables this worker keeps.
_kept: list[Callable] = []


def _keep(kept: tuple[Callable, ...]) -> None:
    for f in _kept:
        if f not in kept:
            f.cache_clear()
    _kept[:] = kept


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *kept: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for workers that outlive its task and go on with other operators: what cached functions of operators
    before it hold goes, but for ``kept``; at the task's end free memory goes back to the system."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep(kept)
        try:
            yield from run(batches)
        finally:
            _give_back()

    return tidied


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset (tests, local mode) a folder of our own."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own:
        return own.rstrip("/")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vellum-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: later jobs read it, whichever executors are lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_remove)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _remove() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the session may have ended; the folder is the cluster's to clean
            return


def spread(df: DataFrame) -> DataFrame:
    """A narrow scan in as many partitions as the session runs at once, where its files give fewer: for passes
    whose work is in the kernel, not in reading. Large tables have more splits and are left as they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df._jdf.queryExecution().toRdd().getNumPartitions() < n else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(name: str, columns: list[str]) -> str:
    """``name``, with underscores in front until no column has it (names match whatever their case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def least_by_hash(df: DataFrame, key: str, n: int, *then: str) -> DataFrame:
    """The ``n`` rows with the least hash of ``key``, nulls aside. A bound on the hash leaves about four times as
    many in the whole table, so that partitions send the driver a few rows each, however many there are."""
    from pyspark.sql import functions as F

    known = df.where(F.col(key).isNotNull())
    total = known.count()
    bound = int(min(1.0, 4 * n / max(total, 1)) * (1 << 30))
    h = F.xxhash64(key)
    return known.where(F.pmod(h, F.lit(1 << 30)) <= bound).orderBy(F.pmod(h, F.lit(1 << 30)), key, *then).limit(n)

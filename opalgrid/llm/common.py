"""Helpers shared by the training-data operators: word splitting, hashing, scratch tables."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from opalgrid.session import ship

_own_dir: list[str] = []

#: Rows in one Arrow batch. A batch of long documents stays within tens of MB.
ARROW_ROWS = 1000

#: How stashes are written where the shared folder is a local path. Hadoop starts a ``chmod`` there for every
#: file and folder it makes, and until that runs the started process counts as large as the executor; without
#: checksum files and success marks there are two a file instead of three. Other file systems don't see these options.
SCRATCH = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}


def tune(spark: SparkSession) -> None:
    """Before Python stages: bound one Arrow batch, as texts may be long, ship this package, and empty the heaps."""
    ship(spark)
    empty_heaps(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def empty_heaps(spark: SparkSession) -> None:
    """One full collection in each executor (there is one task for each, and nothing else runs). A heap that a
    finished step has filled stays at its largest otherwise, beside the Python workers of the next one; after a
    full collection the JVM gives free heap back to the system."""
    n = max(1, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1)
    spark.range(0, n, 1, n).selectExpr("reflect('java.lang.System', 'gc') AS done").collect()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, a temporary one on a local master
    (tests); on a cluster each executor would write to its own disk, so that raises."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="opalgrid-"))
    return _own_dir[0]


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: this cuts lineage,
    survives lost executors, and keeps Python stages from running twice. The files go when
    the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    df.write.options(**SCRATCH).parquet(path)
    place, fs = _place(spark, path)
    fs.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def release(spark: SparkSession, *stashes: DataFrame) -> None:
    """Delete stashes that no later step reads, and let Spark's cleaner drop the shuffle files of
    finished steps now (it waits for the driver's garbage collection); then the executors collect theirs."""
    for df in stashes:
        place, fs = _place(spark, df._stash_path)
        fs.delete(place, True)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    empty_heaps(spark)


def hash_sample(df: DataFrame, key: str, most: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """At most ``most`` rows, those with the smallest hashes of ``key``, rows of equal keys in the order of
    ``ties``. A first filter by hash, from the count of rows, lets about that many leave the
    executors, however many tasks there are."""
    n, place = df.count(), F.pmod(F.xxhash64(key), F.lit(1 << 40))
    rows = df.withColumn("__h", place)
    if n > 2 * most:
        rows = rows.where(F.col("__h") < int(1.2 * most / n * (1 << 40)))
    return rows.orderBy("__h", key, *ties).limit(most).drop("__h")


def spread(df: DataFrame, columns: list[str], most: int) -> DataFrame:
    """``df``, just written and read back, with ``__salt``: 0, but for rows that agree in ``columns`` more
    than ``most`` times; those are dealt over as many salts as bring ``most`` of them together, by
    their place in the files, which retried tasks find again."""
    n = df.groupBy(*columns).agg(F.count("*").alias("__n")).where(F.col("__n") > most)
    n = n.select(*[F.col(c).alias(f"__{c}") for c in columns], F.ceil(F.col("__n") / most).cast("long").alias("__parts"))
    on = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns])
    rows = df.withColumn("__place", F.monotonically_increasing_id()).join(n, on, "left")
    # the low bits of a place count rows of a file, the high ones files: both enter the salt
    salt = F.pmod(F.xxhash64("__place"), F.coalesce("__parts", F.lit(1).cast("long")))
    return rows.withColumn("__salt", salt).select(*df.columns, "__salt")


def give_back() -> None:
    """Memory that Arrow and the C library keep for later goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow; at the end of a task its memory goes back, as workers wait beside later stages."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def column_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


class WordHashes(dict):
    """word -> 64-bit hash, kept for repeated words; bounded by ``limit`` entries."""

    limit = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_M1, _M2, _P = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of ``k`` consecutive entries."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, k):
        out = mixed(out * _P + h[i : i + n])
    return out

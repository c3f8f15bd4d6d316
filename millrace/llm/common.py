"""Tables, scratch space and small column helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Rows and bytes of an Arrow batch; the bytes hold however long texts are.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's limits of Arrow batches to what the Python workers of this subpackage count on."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(str(spark.conf.get(key)).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def tidy(f: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A function over batches that hands freed memory back to the system when a task ends: Python workers live on, and
    what one stage had for its peak would add up with the next one's."""

    @wraps(f)
    def run(*args) -> Iterator:
        try:
            yield from f(*args)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # glibc's alone
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below spark.checkpoint.dir; a local folder is set only where the session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        if given.isDefined():
            root = given.get()
        else:
            root = tempfile.mkdtemp(prefix="millrace-")
            spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared scratch folder and read again: lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes the folders of stored tables that nothing reads any more, so that scratch space holds what is in use."""
    for t in tables:
        jvm = t.sparkSession._jvm
        conf = t.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for f in t.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


#: Row keys that are broadcast at most, 8 bytes each and about four times that as a hash table.
BROADCAST_ROWS = 500_000


def row_key(key: str, text: str) -> Column:
    """64 bits that tell rows of one id with different texts apart, and rows without an id."""
    return F.xxhash64(F.col(key), F.col(text))


def among(docs: DataFrame, rows: DataFrame, key: str, text: str, how: str = "left_anti") -> DataFrame:
    """The rows of docs whose row_key isn't (or, with left_semi, is) a `row` of rows, unchanged. A list that was counted and
    is short is broadcast, so that texts stay where they are; a longer one meets them in a shuffle."""
    rows = stored(rows.select(F.col("row").alias("__row")).distinct(), "rows")
    if rows.count() <= BROADCAST_ROWS:
        rows = F.broadcast(rows)
    return docs.join(rows, row_key(key, text) == F.col("__row"), how)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def crc_mod5(doc_id: str = "doc_id") -> Column:
    """crc32 of the id's decimal text, modulo 5; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)).cast("int"), F.lit(-1))


def input_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of df (for file sources the bytes of the files); where it has none or multiplies
    those of a join, 2000 bytes a row of a count."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 50 else 2000 * df.count()


def pieces(spark: SparkSession, rows: int, each: int) -> int:
    """Partitions of about `each` rows; no fewer than the session shuffles to."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), min(1 << 20, -(-rows // each)))

"""Numbered files, one a partition: <path>/0, <path>/1 and so on.

Reading uses the binaryFile source. Writing is a Python data source with two steps: every task writes its file under a
temporary name in the target folder through the Hadoop-free local or mounted file system that all executors share, and
the driver renames them when all have ended, so a failed job leaves no half-written numbered file.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


def read(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(id, path, content) of files 0 to n-1; a missing one is an error."""
    files = [f"{path.rstrip('/')}/{i}" for i in range(n)]
    if not files:
        return spark.createDataFrame([], "id int, path string, content binary")
    df = spark.read.format("binaryFile").load(files)
    bare = F.regexp_replace("path", "^file:/*", "/")
    df = df.select(F.regexp_extract("path", r"([0-9]+)$", 1).cast("int").alias("id"), bare.alias("path"), "content")
    # the source passes over files without a byte; those that it doesn't name exist, or load() had failed
    home = re.sub("^file:/*", "/", path).rstrip("/")
    empty = spark.range(n).select(F.col("id").cast("int").alias("id")).join(df.select("id"), "id", "left_anti")
    return df.unionByName(empty.select("id", F.concat(F.lit(f"{home}/"), "id").alias("path"), F.lit(b"").alias("content")))


def default_serialise(rows: list[dict]) -> bytes:
    """Fields joined by commas, a row a line."""
    return "".join(",".join("" if v is None else str(v) for v in r.values()) + "\n" for r in rows).encode()


@dataclass
class _Written(WriterCommitMessage):
    temporary: str
    name: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, serialise: Callable[[list[dict]], bytes] | None):
        self.path, self.serialise, self.run = path, serialise, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> _Written:
        pid = TaskContext.get().partitionId()
        temporary = f"{self.path}/.{pid}.{self.run}.{TaskContext.get().taskAttemptId()}"
        with open(temporary, "wb") as f:
            if self.serialise is None:
                for b in iterator:
                    f.write(default_serialise(b.to_pylist()))
            else:
                f.write(self.serialise([r for b in iterator for r in b.to_pylist()]))
        return _Written(temporary, f"{self.path}/{pid}")

    def commit(self, messages: list[_Written | None]) -> None:
        for m in messages:
            if m:
                os.replace(m.temporary, m.name)

    def abort(self, messages: list[_Written | None]) -> None:
        for m in messages:
            if m and os.path.exists(m.temporary):
                os.remove(m.temporary)


def save(df: DataFrame, path: str, serialise: Callable[[list[dict]], bytes] | None = None) -> None:
    """Writes partition i of df to <path>/i, an empty partition as what serialise makes of no rows. A serialiser of one's own
    gets a whole partition, since its format may need that; lines of fields are written a batch at a time."""
    path = re.sub("^file:/*", "/", path)
    os.makedirs(path, exist_ok=True)

    class PartFiles(DataSource):
        @classmethod
        def name(cls) -> str:
            return "millrace_partfiles"

        def writer(self, schema, overwrite):
            return _Writer(path, serialise)

    df.sparkSession.dataSource.register(PartFiles)
    df.write.format("millrace_partfiles").mode("append").save()

"""Shared plumbing of the training-data operators: shared-folder tables and sizes."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder

_ROOTS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's part of the folder that every executor sees."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        _ROOTS[app] = f"{shared_folder(spark)}/lexloom-{uuid.uuid4().hex}"
        atexit.register(remove, spark, _ROOTS[app])
    return _ROOTS[app]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system; a session that has ended leaves it to the cluster's cleaner."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  only at shutdown, or when the table is gone already
        pass


class Table:
    """A table written to the shared folder: cuts the lineage and outlives a lost executor."""

    def __init__(self, df: DataFrame, tag: str, by: str | None = None, file_rows: int = 0):
        """by: a column whose values are written, and may be dropped, apart.  file_rows: most rows of a file; writers and readers hold up to some thousand rows of one, however long."""
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{tag}-{uuid.uuid4().hex[:12]}"
        # the shuffle files that led to a table are of no use once it is written
        clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(clean, "false")
        self.spark.conf.set(clean, "true")
        try:
            df.write.options(compression="zstd", maxRecordsPerFile=file_rows).partitionBy(*([by] if by else [])).parquet(self.path)
        finally:
            self.spark.conf.set(clean, before)
        self.schema = df.schema

    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path).select(self.schema.names)

    def drop(self, part: str = "") -> None:
        """part: only the rows of one value, as column=value."""
        remove(self.spark, f"{self.path}/{part}" if part else self.path)


def materialize(df: DataFrame, tag: str, file_rows: int = 0) -> DataFrame:
    return Table(df, tag, file_rows=file_rows).df()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: Bytes of text that a function handles at once.
SLICE = 2 << 20


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``size`` bytes of text each; a longer text is a range of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)
    begin = held = 0
    for k, n in enumerate(sizes.tolist()):
        if held and held + n > size:
            yield begin, k
            begin, held = k, 0
        held += n
    if begin < len(sizes):
        yield begin, len(sizes)


_MEMORIES: dict[str, Callable[[], None]] = {}


def remembers(owner: str, forget: Callable[[], None]) -> None:
    """A worker process serves many stages: what other operators remember is dropped when one begins."""
    for name, clear in _MEMORIES.items():
        if name != owner:
            clear()
    _MEMORIES[owner] = forget

"""Session settings and table access shared by all operators."""

from __future__ import annotations

import contextlib
import datetime as dt
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The instant at which queries over the sample tables are evaluated; operators take it as a parameter.
NOW = dt.datetime(2024, 1, 31)


def session(app: str = "lexloom", **conf: str) -> SparkSession:
    """A session with the settings the operators expect: UTC, adaptive plans, skew handling."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt evenly over all cores, some tasks for each: for heavy work on narrow rows, of which one small file holds many."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def at(instant: dt.datetime) -> Column:
    """An instant as a literal without time zone, so that plans never read the wall clock."""
    return F.lit(instant.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a session on one machine may do without; it gets a temporary folder.  On a cluster that would be
    another folder on each machine, so the setting is asked for.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="lexloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder of the session."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """The rows written to the shared folder and read again; the shuffle files that led to them go.

    Read by column, and, unlike a checkpoint, without the constraints of its plan, which a later union may trip over.
    """
    spark, clean = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = f"{folder or shared_folder(spark)}/stored-{uuid.uuid4().hex}", spark.conf.get(clean, "false")
    spark.conf.set(clean, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(clean, before)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """A ``stored`` whose tables go when the work ends."""
    folder = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    try:
        yield lambda df: stored(df, folder)
    finally:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

"""Tables that are replaced as a whole: each version is a folder, and the last one that is complete counts.

Spark marks a folder with ``_SUCCESS`` as its last act, so a reader finds the old version or the new one, never a
part, and no pointer is written over.  Older versions stay until they are dropped, for readers that began with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _files(spark: SparkSession, base: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def versions(spark: SparkSession, base: str) -> list[int]:
    """Complete versions, the oldest first."""
    fs, path = _files(spark, base)
    if not fs.exists(path):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(path)]
    numbers = sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdecimal())
    return [n for n in numbers if fs.exists(_files(spark, f"{base}/v{n}/_SUCCESS")[1])]


def replace(table: DataFrame, base: str, number: int | None = None) -> int:
    """Write the table as the next version, or as that number; a version that a lost driver left incomplete is written anew."""
    if number is None:
        number = max(versions(table.sparkSession, base), default=0) + 1
    table.write.mode("overwrite").parquet(f"{base}/v{number}")
    return number


def read(spark: SparkSession, base: str) -> DataFrame:
    found = versions(spark, base)
    if not found:
        raise FileNotFoundError(f"no complete version in {base}")
    return spark.read.parquet(f"{base}/v{found[-1]}")


def drop_old(spark: SparkSession, base: str, keep: int = 2) -> None:
    for number in versions(spark, base)[:-keep]:
        fs, path = _files(spark, f"{base}/v{number}")
        fs.delete(path, True)

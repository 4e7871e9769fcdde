"""Partition overwrite for late arrivals: a table of day folders that late rows rewrite as far as they must.

A layout keeps the latest-arrived row of every key and cuts each day, in order of time and
key, into Parquet files of a fixed number of rows.  ``write_layout`` makes one from the rows that came in
time.  ``record_index`` reads back which day and file each key is in, as a table that is
hash-partitioned (bucketed) by the key, so that a probe moves only the probing rows.  ``overwrite`` takes
the late rows: the latest of each key probes the index and is tagged with the day and file
of its key at the start; a day is dirty where a late row that is kept stands, or where its key stood.  Only the files of dirty days
are read again; the keys of late rows leave them, the late rows join, the days are cut anew, and a dynamic partition
overwrite replaces them.  Folders that a day no longer needs are deleted.  All other files stay as they are.

Rows get their place in a day from a range partition of all rows: a row's number inside its
partition, plus the rows of the day in the partitions before, which is a sum over one row for each partition and day.
So no day has to be sorted by one task; a file is written by one task, streaming.

Defined results: of rows of one key the latest ``arrived`` wins, a null one loses to all others; rows that tie are
ordered by their other columns, null first, and the greatest wins; a null key is a key like any other; a null time is day -1, and sorts before
all others; rows without an arrival are late; late rows that lose to a row in place change nothing; an empty table gives no files and an empty
report; other columns are carried as they are; a name like that of a folder column is refused.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..session import shared_folder
from .common import Table, materialize, remove, shuffle_partitions

#: A day is cut into files of one more than so many parts of the rows.
PARTS = 700
FOLDERS = ("day", "file_no")


def day_of(time: Column) -> Column:
    """Whole days since 1970; null: -1."""
    return F.coalesce(F.unix_date(time.cast("date")), F.lit(-1)).cast("long")


def micros(time: Column) -> Column:
    """Microseconds since 1970 of a timestamp without a zone, whatever the session's zone."""
    seconds = F.unix_date(time.cast("date")).cast("long") * 86400 + F.hour(time) * 3600 + F.minute(time) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), time) * 1_000_000).cast("long")


@dataclass(frozen=True)
class Layout:
    """A table of day folders: where it is, its columns, key, time and arrival, and the rows of a file."""

    path: str
    schema: StructType
    key: str
    time: str
    arrived: str
    rows_per_file: int

    @property
    def columns(self) -> list[str]:
        return self.schema.names

    def latest(self, rows: DataFrame) -> DataFrame:
        """The row of each key that arrived last."""
        order = [self.arrived, self.time, *(c for c in self.columns if c not in (self.arrived, self.time, self.key))]
        best = rows.groupBy(self.key).agg(F.max(F.struct(*order)).alias("__best"))
        return best.select(*(self.key if c == self.key else F.col(f"__best.{c}").alias(c) for c in self.columns))

    def cut(self, rows: DataFrame) -> DataFrame:
        """Rows with their day and the number of their file in it."""
        order = ["day", self.time, self.key]
        dealt = rows.withColumn("day", day_of(F.col(self.time))).repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
        placed = materialize(dealt.withColumn("__row", F.monotonically_increasing_id()), "sorted")
        part = F.shiftright("__row", 33).alias("__part")
        counts = placed.groupBy(part, "day").agg(F.count(F.lit(1)).alias("n"), F.min("__row").alias("first"))
        before = F.sum("n").over(Window.partitionBy("day").orderBy("__part")) - F.col("n")
        offsets = counts.select("__part", "day", (before - F.col("first")).alias("__offset"))
        numbered = placed.withColumn("__part", part).join(offsets, ["__part", "day"])
        return numbered.select(*self.columns, "day", F.floor((F.col("__row") + F.col("__offset")) / self.rows_per_file).cast("int").alias("file_no"))

    def write(self, cut: DataFrame) -> None:
        """Each file by one task, in order; days and files that are there already are replaced."""
        order = [*FOLDERS, self.time, self.key]
        dealt = cut.repartition(shuffle_partitions(cut.sparkSession), *FOLDERS).sortWithinPartitions(*order)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", 0).partitionBy(*FOLDERS).parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        """All rows, with day, file_no, path, and their place in the file."""
        kept = spark.read.schema(StructType([*self.schema, StructField("day", LongType()), StructField("file_no", IntegerType())])).parquet(self.path)
        return kept.select(*self.columns, *FOLDERS, F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"))


def new_layout(rows: DataFrame, key: str, time: str, arrived: str, rows_per_file: int, tag: str = "late") -> Layout:
    """An empty layout in a folder of its own, which is left where it is."""
    if taken := {x.lower() for x in rows.columns} & {*FOLDERS, "path", "row"}:
        raise ValueError(f"columns {sorted(taken)} would clash with those of the folders")
    spark = rows.sparkSession
    return Layout(f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}", rows.schema, key, time, arrived, rows_per_file)


class Index:
    """key -> day and file of a layout, hash-partitioned by the key."""

    def __init__(self, layout: Layout, spark: SparkSession):
        self.spark, self.name = spark, f"record_index_{uuid.uuid4().hex}"
        n = shuffle_partitions(spark)
        rows = layout.read(spark).select(F.col(layout.key).alias("key"), *FOLDERS, "path").repartition(n, "key")
        rows.write.option("path", f"{layout.path}-index").bucketBy(n, "key").sortBy("key").format("parquet").saveAsTable(self.name)

    def df(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> None:
        """The catalogue forgets the index; its files stay in their folder."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def overwrite(layout: Layout, index: Index, late: DataFrame) -> DataFrame:
    """Bring late rows into a layout; returns what was rewritten: one row for each dirty day."""
    spark = late.sparkSession
    winners = layout.latest(late)
    found = index.df().select(F.col("key").alias(layout.key), F.col("day").alias("old_day"), F.col("file_no").alias("old_file"))
    null_key = F.col(layout.key).isNull()
    tagged = winners.filter(~null_key).join(found.filter(~null_key), layout.key, "left")
    none = winners.filter(null_key)  # one row at most
    tagged = tagged.unionByName(none.join(found.filter(null_key).select("old_day", "old_file"), F.lit(True), "left"), allowMissingColumns=True)
    # a late row without an arrival gives way to any row that is there
    tagged = Table(tagged.filter(F.col(layout.arrived).isNotNull() | F.col("old_day").isNull()), "tagged")
    kept = tagged.df()
    dirty = materialize(kept.select(F.explode(F.array_distinct(F.array(day_of(F.col(layout.time)), "old_day"))).alias("day")).filter("day IS NOT NULL").distinct(), "dirty")
    days = [r["day"] for r in dirty.collect()]  # of the calendar, however many rows there are
    again = layout.read(spark).filter(F.col("day").isin(days)).select(*layout.columns, "file_no", "day")
    # the keys of late rows leave the files that they were found in
    gone = kept.filter("old_day IS NOT NULL").select(F.col(layout.key).alias("__key"), "old_day", "old_file")
    stay = again.join(gone, F.col(layout.key).eqNullSafe(F.col("__key")) & (F.col("day") == F.col("old_day")) & (F.col("file_no") == F.col("old_file")), "left_anti")
    cut = Table(layout.cut(stay.select(*layout.columns).unionByName(kept.select(*layout.columns))), "cut")
    before = layout.read(spark).filter(F.col("day").isin(days)).select(*FOLDERS).distinct()
    unneeded = before.join(cut.df().select(*FOLDERS).distinct(), list(FOLDERS), "left_anti").collect()  # at most a folder for each file
    layout.write(cut.df())
    for r in unneeded:
        remove(spark, f"{layout.path}/day={r['day']}/file_no={r['file_no']}")
    cut.drop()
    tagged.drop()
    return dirty


def report(layout: Layout, spark: SparkSession, index: Index, cents: Column, crc: Column, ids: Column) -> DataFrame:
    """One row for each file: day, file_no, n_rows, cents, rows_crc, path, columns, ids_sha256, rewritten.

    cents, crc: summed over a file's rows; ids: joined by commas in the file's order and hashed, by one
    task for a file, which holds a batch of rows at a time.
    """
    rows = layout.read(spark).select(*FOLDERS, "path", "row", cents.alias("cents"), crc.alias("crc"), ids.cast("string").alias("id"))
    dealt = rows.repartition(shuffle_partitions(spark), "path").sortWithinPartitions("path", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def told():
            day, file_no, path, n, cents, crc, digest = held
            cols = [[day], [file_no], [n], [cents], [crc], [path], [digest.hexdigest()]]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=["day", "file_no", "n_rows", "cents", "rows_crc", "path", "ids_sha256"])

        for batch in batches:
            paths = batch.column(2)
            runs = pc.run_end_encode(paths)
            begin = 0
            for end, path in zip(runs.run_ends.to_pylist(), runs.values.to_pylist(), strict=True):
                part = batch.slice(begin, end - begin)
                if held is None or held[2] != path:
                    if held is not None:
                        yield told()
                    held = [part.column(0)[0].as_py(), part.column(1)[0].as_py(), path, 0, 0, 0, hashlib.sha256()]
                names = pc.fill_null(part.column(6), "").to_pylist()
                held[6].update(("," * (held[3] > 0) + ",".join(names)).encode())
                held[3] += len(names)
                held[4] += pc.sum(part.column(4)).as_py() or 0
                held[5] += pc.sum(part.column(5)).as_py() or 0
                begin = end
        if held is not None:
            yield told()

    files = dealt.mapInArrow(run, "day long, file_no int, n_rows long, cents long, rows_crc long, path string, ids_sha256 string")
    untouched = index.df().select("path").distinct().withColumn("__old", F.lit(True))
    out = files.join(untouched, "path", "left")
    names = ",".join(layout.columns)
    return out.select("day", "file_no", "n_rows", "cents", "rows_crc", "path", F.lit(names).alias("columns"), "ids_sha256", F.col("__old").isNull().alias("rewritten"))


def corrections(sales: DataFrame) -> DataFrame:
    """Sales, and the later corrections of those whose number's crc32 and day say so."""
    h = F.crc32(F.col("sale_id").cast("string").cast("binary"))
    days = lambda n: F.make_dt_interval(n.cast("int"))
    some = sales.filter((h % 3 == 0) & (day_of(F.col("sold_at")) % 7 == 0))
    copies = some.withColumns({"total": F.col("total") + 1, "sold_at": F.col("sold_at") + days(h % 2), "arrived_at": F.col("arrived_at") + days(1 + h % 97)})
    return sales.unionByName(copies)


def sales_report(sales: DataFrame, cutoff: str = "2024-04-10 00:00:00", parts: int = PARTS) -> DataFrame:
    """The layout of sales that arrived before the cutoff, brought up to date with the later ones; one row for each final file."""
    spark = sales.sparkSession
    layout = new_layout(sales, "sale_id", "sold_at", "arrived_at", 1 + sales.count() // parts, "sales")
    rows = corrections(sales)
    early = F.coalesce(F.col("arrived_at") < F.lit(cutoff).cast("timestamp_ntz"), F.lit(False))
    layout.write(layout.cut(layout.latest(rows.filter(early))))
    index = Index(layout, spark)
    try:
        overwrite(layout, index, rows.filter(~early))
        cents = F.coalesce(F.floor(100 * F.col("total") + 0.5).cast("long"), F.lit(0))
        told = F.concat_ws(":", *(F.coalesce(x.cast("string"), F.lit("")) for x in (F.col("sale_id"), micros(F.col("sold_at")), micros(F.col("arrived_at")))))
        return materialize(report(layout, spark, index, cents, F.crc32(told.cast("binary")), F.col("sale_id")), "report")
    finally:
        index.close()

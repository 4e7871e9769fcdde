"""Keyed tables behind a manifest: a merge writes files beside the old ones, and they count once its manifest is there.

A table is dealt into a fixed number of buckets by its key.  A merge reads and writes only the buckets that its
changes touch, and leaves the files of those that only get new keys; tasks stream their buckets to new files and tell the driver names and counts, and the commit writes
one manifest of all files that count.  A manifest appears as a whole under the next number, which only one writer can
take: a reader sees the old version or the new one, a writer that comes second works its merge out anew, and
files of failed or repeated tasks are in no manifest.  The driver holds names of files and numbers of buckets, never rows.

Atomic numbering needs a file system whose rename (or link, on a local one) refuses a name that is taken.
"""

from __future__ import annotations

import collections
import json
import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..session import scratch

BUCKET = "__bucket"
#: Files of a bucket that new keys may add to; a bucket of more is written anew.
FILES = 8
FORMAT = "lexloom_manifest"


class Conflict(RuntimeError):
    """Another writer took the version that this merge was worked out for, each time it was tried."""


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]  # bucket, name, rows


class Store:
    """Manifests and files of one table; folder: a path or URI that driver and executors share."""

    def __init__(self, folder: str):
        self.files, self.root = fs.FileSystem.from_uri(folder)

    def versions(self) -> list[int]:
        found = self.files.get_file_info(fs.FileSelector(f"{self.root}/manifests", allow_not_found=True))
        return sorted(int(x.base_name[:-5]) for x in found if x.base_name.endswith(".json") and x.base_name[:-5].isdecimal())

    def _manifest(self, version: int) -> str:
        return f"{self.root}/manifests/{version:08d}.json"

    def load(self, version: int) -> dict:
        with self.files.open_input_stream(self._manifest(version)) as f:
            return json.loads(f.read())

    def publish(self, version: int, manifest: dict) -> None:
        """Give the manifest its number, or fail if another writer has it."""
        self.files.create_dir(f"{self.root}/manifests")
        draft, final = f"{self.root}/manifests/{uuid.uuid4().hex}.draft", self._manifest(version)
        with self.files.open_output_stream(draft) as f:
            f.write(json.dumps(manifest).encode())
        if isinstance(self.files, fs.LocalFileSystem):
            try:
                os.link(draft, final)  # a local rename would write over the other manifest
            finally:
                self.files.delete_file(draft)
        else:
            self.files.move(draft, final)

    def path(self, name: str) -> str:
        return f"{self.root}/data/{name}"

    def remove(self, names: list[str]) -> None:
        for name in names:
            if self.files.get_file_info(self.path(name)).type != fs.FileType.NotFound:
                self.files.delete_file(self.path(name))


class BucketWriter(DataSourceArrowWriter):
    """Streams sorted buckets to files, one open at a time; rows of a bucket that comes back get a further file."""

    def __init__(self, folder: str, base: int, manifest: dict):
        self.folder, self.base, self.manifest = folder, base, manifest

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, told = Store(self.folder), []
        store.files.create_dir(f"{store.root}/data")
        writer = None
        try:
            for batch in iterator:
                buckets = batch.column(0).to_numpy()
                rows = pa.Table.from_batches([batch]).drop_columns([BUCKET])
                edges = [0, *(i for i in range(1, len(buckets)) if buckets[i] != buckets[i - 1]), len(buckets)]
                for start, end in zip(edges, edges[1:], strict=False):
                    if start == end:
                        continue
                    bucket = int(buckets[start])
                    if writer is None or told[-1]["bucket"] != bucket:
                        if writer:
                            writer.close()
                        told.append({"bucket": bucket, "name": f"{uuid.uuid4().hex}.parquet", "rows": 0})
                        writer = pq.ParquetWriter(store.path(told[-1]["name"]), rows.schema, filesystem=store.files)
                    writer.write_table(rows.slice(start, end - start))
                    told[-1]["rows"] += end - start
        finally:
            if writer:
                writer.close()
        return Written(told)

    def commit(self, messages: list[Written | None]) -> None:
        files = self.manifest["files"] + [x for m in messages if m for x in m.files]
        Store(self.folder).publish(self.base + 1, self.manifest | {"files": files})

    def abort(self, messages: list[Written | None]) -> None:
        Store(self.folder).remove([x["name"] for m in messages if m for x in m.files])


class ManifestSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> BucketWriter:
        return BucketWriter(self.options["folder"], int(self.options["base"]), json.loads(self.options["manifest"]))


def _nullable(schema):
    """The JSON of a schema with nulls allowed everywhere: what one merge rules out the next may hold."""
    if isinstance(schema, list):
        return [_nullable(x) for x in schema]
    if not isinstance(schema, dict):
        return schema
    return {k: True if k in ("nullable", "containsNull", "valueContainsNull") else _nullable(v) for k, v in schema.items()}


def current(folder: str) -> tuple[int, dict | None]:
    """Number and manifest of the last version; 0 and None before the first."""
    store = Store(folder)
    found = store.versions()
    return (found[-1], store.load(found[-1])) if found else (0, None)


def _rows(spark: SparkSession, folder: str, manifest: dict, touched: set[int] | None = None) -> DataFrame:
    store, schema = Store(folder), StructType.fromJson(manifest["schema"])
    scheme = folder.split(":", 1)[0] + "://" if "://" in folder and isinstance(store.files, fs.LocalFileSystem) else None
    base = scheme + store.root if scheme else folder.rstrip("/")
    paths = [f"{base}/data/{x['name']}" for x in manifest["files"] if touched is None or x["bucket"] in touched]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _bucket(held: dict) -> Column:
    return F.pmod(F.xxhash64(*held["by"]), F.lit(held["buckets"])).cast("int")


def read(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The last version, or the one of that number as long as it is kept."""
    if version is None:
        version = current(folder)[0]
    if not version:
        raise FileNotFoundError(f"no version in {folder}")
    return _rows(spark, folder, Store(folder).load(version))


def merge(changes: DataFrame, folder: str, key: list[str], values: dict[str, Column] | None = None, drop: Column | None = None, buckets: int = 64, batch: int | None = None, attempts: int = 5, by: list[str] | None = None, written: bool = False) -> int:
    """Merge changes by key; the number of the version that holds them.

    changes: at most one row for each key (``latest`` makes them so; a second one fails the job); a null is a key like
    others.  values: columns over ``old`` and ``new``, structs of all columns that are null where there is no such row;
    a column without one takes the new row where there is one.  drop: rows that leave the table, over the same structs.
    buckets, and by, the columns of the key that deal rows into them: set by the first merge.  batch: number of a stream's batch; one that is in the table already changes nothing.
    written: changes are a table that is read, so that they need not be written for the merge.
    """
    changes.sparkSession.dataSource.register(ManifestSink)
    if written:
        return _merge(changes, folder, key, values, drop, buckets, batch, attempts, by)
    with scratch(changes.sparkSession) as keep:  # the same rows for the choice of buckets and for the merge
        return _merge(keep(changes), folder, key, values, drop, buckets, batch, attempts, by)


def _merge(changes: DataFrame, folder: str, key: list[str], values: dict[str, Column] | None, drop: Column | None, buckets: int, batch: int | None, attempts: int, by: list[str] | None) -> int:
    spark, names = changes.sparkSession, changes.columns
    for _ in range(attempts):
        base, held = current(folder)
        held = held or {"schema": _nullable(changes.schema.jsonValue()), "key": key, "by": by or key, "buckets": buckets, "batch": None, "files": []}
        if held["key"] != key or StructType.fromJson(held["schema"]).names != names:
            raise ValueError(f"{folder} has key {held['key']} and columns {StructType.fromJson(held['schema']).names}")
        if batch is not None and held["batch"] is not None and batch <= held["batch"]:
            return base
        bucket = _bucket(held).alias(BUCKET)
        touched = {r[0] for r in changes.select(bucket).distinct().collect()}  # at most as many as buckets
        again = touched & _met(changes, folder, held)
        row = F.struct(*names)
        old = _rows(spark, folder, held, again).select(bucket, *key, row.alias("old"), F.lit(None).cast(changes.select(row).schema[0].dataType).alias("new"))
        new = changes.select(bucket, *key, F.lit(None).cast(old.schema["old"].dataType).alias("old"), row.alias("new"))
        # one exchange by bucket serves the grouping by key and the files
        met = old.unionByName(new).repartition(BUCKET).groupBy(BUCKET, *key).agg(F.any_value("old", ignoreNulls=True).alias("old"), F.any_value("new", ignoreNulls=True).alias("new"), F.count("new").alias("n"))
        once = F.when(F.col("n") > 1, F.raise_error("a key has several changes").cast("boolean")).otherwise(F.lit(True))
        met = met.filter(once if drop is None else once & ~F.coalesce(drop, F.lit(False)))
        types = {f.name: f.dataType for f in StructType.fromJson(held["schema"])}
        chosen = {c: F.when(F.col("new").isNotNull(), F.col("new")[c]).otherwise(F.col("old")[c]) for c in names} | (values or {})
        out = met.select(BUCKET, *(chosen[c].cast(types[c]).alias(c) for c in names)).sortWithinPartitions(BUCKET)
        kept = held | {"batch": held["batch"] if batch is None else batch, "files": [x for x in held["files"] if x["bucket"] not in again]}
        try:
            out.write.format(FORMAT).mode("append").options(folder=folder, base=str(base), manifest=json.dumps(kept)).save()
            return base + 1
        except Exception:
            if current(folder)[0] == base:  # not a race: the job itself failed
                raise
    raise Conflict(folder)


def _met(changes: DataFrame, folder: str, held: dict) -> set[int]:
    """Buckets that are read and written anew: those that hold a key of the changes, found by keys alone, or many files; others get a further file."""
    if not held["files"]:
        return set()
    count = collections.Counter(x["bucket"] for x in held["files"])
    keys = lambda rows, of: rows.select(_bucket(held).alias(BUCKET), *held["key"], F.lit(of).alias("__of"))
    both = keys(changes, 1).union(keys(_rows(changes.sparkSession, folder, held), 2)).groupBy(BUCKET, *held["key"]).agg(F.bit_or("__of").alias("__of"))
    return {r[0] for r in both.filter("__of = 3").select(BUCKET).distinct().collect()} | {b for b, n in count.items() if n >= FILES}


def near(changes: DataFrame, folder: str) -> DataFrame:
    """The rows of the buckets that changes touch: all that may have one of their keys (or the columns that deal the buckets), and little else of a large table."""
    _, held = current(folder)
    if not held:
        return changes.limit(0)
    return _rows(changes.sparkSession, folder, held, {r[0] for r in changes.select(_bucket(held)).distinct().collect()})


def latest(changes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of several changes of a key the last one by order, nulls before all values; ties go by the other columns in turn."""
    rest = [c for c in changes.columns if c not in order]
    return changes.groupBy(*(F.col(c).alias(f"__{c}") for c in key)).agg(F.max(F.struct(*order, *rest)).alias("row")).select(*(F.col("row")[c].alias(c) for c in changes.columns))


def drop_old(folder: str, keep: int = 2, age: float = 86_400.0) -> list[str]:
    """Forget all but the last versions and the files that none of these holds; younger files may belong to a writer at work."""
    store = Store(folder)
    found = store.versions()
    for number in found[:-keep]:
        store.files.delete_file(store._manifest(number))
    held = {x["name"] for number in found[-keep:] for x in store.load(number)["files"]}
    there = store.files.get_file_info(fs.FileSelector(f"{store.root}/data", allow_not_found=True))
    gone = [x.base_name for x in there if x.base_name not in held and x.mtime.timestamp() < time.time() - age]
    store.remove(gone)
    return gone

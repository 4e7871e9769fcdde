"""Exact deduplication by a tree-merge of sorted digest runs (DataFrame functions only).

Every scan partition makes one run: its distinct digests in order, each with the smallest
identifier and the number of rows.  A run lies in cells by the leading bits of the digest,
each a sorted array of bounded length.  In round k the run whose bit k is set sends its cells to the run
that lacks just that bit (a binomial tree), where the two sorted arrays are merged into one: the sort
of two rising runs laid end to end is a single merging pass.  Neighbours that agree in digest, length and
a second hash become one entry with the smaller identifier.  So a digest that a third of all rows share
is one entry of each run, and no task ever meets more than two of it.

The last run answers the first ones, which hold a digest once each, and those answer their own rows.

Defined results: a null text counts as empty; a null identifier loses against any other
and is returned as null; of rows that agree in text and identifier the first scanned one
stays; very long texts are hashed whole; an empty table gives an empty result; other columns of the
input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

WHITE = r"[\x20\x09-\x0D]+"


def normalized(col):
    """The text as it is compared: null is empty, each run of ASCII white space is one space."""
    return F.regexp_replace(F.coalesce(col, F.lit("")), WHITE, " ")


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = docs.select(F.col(id_col).alias("id"), normalized(F.col(text_col)).alias("t"))
    return text.select(
        "id",
        F.unhex(F.sha2("t", 256)).alias("digest"),
        F.octet_length("t").alias("size"),
        F.xxhash64("t").alias("check"),
        F.spark_partition_id().alias("run"),
        F.monotonically_increasing_id().alias("row"),
    )


# The length and a second, independent hash verify each digest match at every level.
KEY = ["digest", "size", "check"]


#: Entries of a cell, about; rounds whose lineage is cut at once.
CELL, AT_ONCE = 4096, 4


def _same(a: Column, b: Column) -> Column:
    return (a["digest"] == b["digest"]) & (a["size"] == b["size"]) & (a["check"] == b["check"])


def _round(runs: DataFrame, bit: int) -> DataFrame:
    """Runs that differ in this bit alone, merged into the one without it."""
    target = F.col("run").bitwiseAND(F.lit(~(1 << bit)))
    pair = runs.groupBy(target.alias("run"), "cell").agg(F.sort_array(F.flatten(F.collect_list("entries"))).alias("e"))
    # a digest stands at most twice, the smaller identifier first: that one takes the other's rows
    after = lambda i: F.get("e", i + 1)
    met = F.transform("e", lambda x, i: F.when(_same(x, after(i)), x.withField("n", x["n"] + after(i)["n"])).otherwise(x))
    merged = pair.select("run", "cell", "e", met.alias("met"))
    return merged.select("run", "cell", F.filter("met", lambda x, i: (i == 0) | ~_same(x, F.get("e", i - 1))).alias("entries"))


def _merged(leaf: DataFrame, last: int, rows: int) -> DataFrame:
    """All distinct digests, each with its first row and the number of rows."""
    cells = max(1, -(-rows // CELL))
    lead = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    cell = F.shiftright(lead * F.lit(cells), 32).alias("cell") if cells < 1 << 31 else lead.alias("cell")
    entry = F.struct(*KEY, "first", "n")
    runs = leaf.groupBy("run", cell).agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    for bit in range(max(last, 0).bit_length()):
        runs = _round(runs, bit)
        if bit % AT_ONCE == AT_ONCE - 1:
            runs = materialize(runs, "runs")
    return runs.select(F.explode("entries").alias("x")).select("x.*")


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows with their digests, and the same with their group: first, n."""
    rows = materialize(_digests(docs, id_col, text_col), "digests")
    # null identifiers sort after all others
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    leaf = materialize(rows.groupBy("run", *KEY).agg(first, F.count(F.lit(1)).alias("n")), "leaves")
    last, n = leaf.agg(F.max("run"), F.count(F.lit(1))).first()
    found = leaf.select("run", *KEY).join(_merged(leaf, last or 0, n), KEY)
    return rows, rows.join(found, ["run", *KEY])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256."""
    return _grouped(docs, id_col, text_col)[1].select(
        F.col("id").alias("doc_id"),
        F.col("first.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    rows, grouped = _grouped(docs, id_col, text_col)
    keys = grouped.filter(F.col("row") == F.col("first.row")).select(F.col("id").alias("__keep_id"), F.col("digest").alias("__keep_digest"))
    digest = F.unhex(F.sha2(normalized(F.col(text_col)), 256))
    same = F.col("__keep_id").eqNullSafe(docs[id_col]) & (F.col("__keep_digest") == digest)
    out = docs.join(keys, same, "left_semi")
    # rows that repeat both identifier and text still stand side by side; drop the extra ones where there are any
    if rows.groupBy("id", "digest").count().filter("count > 1").limit(1).count():
        out = out.withColumn("__digest", digest).dropDuplicates([id_col, "__digest"]).drop("__digest")
    return out


ORACLE_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
h AS (SELECT doc_id, sha256(t) AS text_sha256, row_number() OVER (PARTITION BY t ORDER BY doc_id) AS k,
             min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, text_sha256 FROM h
"""

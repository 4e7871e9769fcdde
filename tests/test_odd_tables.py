"""Queries against their SQL on tables whose size or rows the sample tables do not have."""

import time

import duckdb
import pytest

from lexloom import registry
from lexloom.sources import readers


def both(spark, folder, name, **tables):
    """Sorted rows of the query and of its SQL over tables written to a folder."""
    con = duckdb.connect()
    for table, rows in tables.items():
        rows.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = registry.QUERIES[name](spark, str(folder))
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({registry.SQL[name]})").fetchall()
    key = lambda row: tuple(map(str, row))
    return sorted((tuple(r) for r in got.select(*cols).collect()), key=key), sorted(want, key=key)


@pytest.fixture(scope="module")
def parts(spark):
    """One brand of more than 1,000 pages of three parts, and a small one."""
    return spark.range(3500).selectExpr("id AS p_partkey", "concat('part ', id) AS p_name", "CASE WHEN id < 3400 THEN 'Brand#1' ELSE 'Brand#2' END AS p_brand")


def documents(spark, texts):
    return spark.createDataFrame([(k, x, "en", "s", len(x or "")) for k, x in enumerate(texts, 1)], "doc_id long, text string, lang string, source string, n_chars long")


def test_pages_of_a_long_search(spark, tmp_path, parts):
    got, want = both(spark, tmp_path, "paged_listing", part=parts)
    assert got == want == [(100, "Brand#2"), (3400, "Brand#1")]


def test_near_ranks_that_round_alike(spark, tmp_path):
    """Sixty ranks that are 1 to nine decimals; the later ones are larger beyond them."""
    got, want = both(spark, tmp_path, "full_text_near", documents=documents(spark, ["title\n" + "of the was " * (17 if k < 30 else 22) for k in range(60)]))
    assert got == want and sorted(r[0] for r in got) == list(range(1, 51))


def test_short_pages(spark, tmp_path):
    html = ["<h1>A &amp; B</h1><article>short</article>", "<article>" + "long enough " * 9 + "</article>", "<h1>T</h1>", "<h1>Whole</h1><article>" + "word " * 20 + "</article>", None]
    pages = spark.createDataFrame([(k, f"https://x.org/{k}", h) for k, h in enumerate(html)], "page_id long, url string, html string")
    got, want = both(spark, tmp_path, "company_listing", pages=pages)
    assert got == want and len(got) == len(html)
    told = {r.url[-1]: r.status for r in readers.company_pages(pages, "article").collect()}
    assert told == {"0": "invalid", "1": "invalid", "2": "invalid", "3": "ok", "4": "invalid"}


def test_long_titles(spark, tmp_path):
    """Texts without a line end are one title; work on them grows with their letters, not with the square."""
    words = ["the", "of", "other", "soft", "des", "und", "que", "lark"]
    texts = [" ".join(words[(k + i * i) % 5] + str(i % 997) for i in range(9000)) for k in range(60)] + ["The other\nof", "soft thesis", "des"]
    begin = time.time()
    for name in ("title_match", "streaming_matches"):
        got, want = both(spark, tmp_path / name, name, documents=documents(spark, texts).repartition(4))
        assert got == want and len(got) > 60
    assert time.time() - begin < 60

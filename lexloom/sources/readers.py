"""Readers: paged JSON listings, job boards, company sites, posting pages, stored tables.

Pages are landed by a fetcher (no operator opens a connection); these functions turn landed
payloads into rows.  A provider of the paged kind is a PageSource with two callables, so a
new one is a few lines of configuration.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import parsers
from ..functions import text as t

LISTING = "source string, source_id string, url string, title string, summary string, published_at string, search_name string, position long"


@dataclass(frozen=True)
class Search:
    name: str
    text: str


@dataclass
class PageSource:
    """A paged listing: fetch(search, cursor) gives a payload, read(payload) its rows and the next cursor."""

    name: str
    fetch: Callable[[Search, str | None], object]
    read: Callable[[object], tuple[list[dict], str | None]]
    max_pages: int | None = 1000  # of a search; None: all of them
    searches: list[Search] = field(default_factory=list)


def allocations(searches: int, budget: int, most: int | None) -> list[int]:
    """Pages for each search: the budget shared evenly, the first ones get what is left over."""
    shares = [budget // searches + (k < budget % searches) for k in range(searches)]
    return shares if most is None else [min(most, x) for x in shares]


def pages(source: PageSource, search: Search, budget: int) -> Iterator[dict]:
    """Rows of one search: follows cursors until there is none, one repeats, or the budget is used."""
    cursor, seen = None, set()
    for _ in range(budget):
        rows, following = source.read(source.fetch(search, cursor))
        yield from rows
        if not following or following in seen:
            return
        seen.add(following)
        cursor = following


@dataclass
class _Part(InputPartition):
    search: Search
    budget: int
    first: int


class ListingReader(DataSourceReader):
    """One partition for each search; positions keep the order of searches and rows."""

    def __init__(self, source: PageSource, budget: int):
        self.source, self.budget = source, budget

    def partitions(self):
        shares = allocations(len(self.source.searches), self.budget, self.source.max_pages) if self.source.searches else []
        return [_Part(s, n, k << 32) for k, (s, n) in enumerate(zip(self.source.searches, shares, strict=True))]

    def read(self, partition):
        for k, x in enumerate(pages(self.source, partition.search, partition.budget)):
            yield (self.source.name, str(x["id"]), x.get("url"), x.get("title"), x.get("summary"), x.get("published_at"), partition.search.name, partition.first + k)


def listing_source(provider: str, source: PageSource, budget: int) -> type[DataSource]:
    """A data source of that name, for spark.dataSource.register and spark.read.format."""

    class Listing(DataSource):
        @classmethod
        def name(cls):
            return provider

        def schema(self):
            return LISTING

        def reader(self, schema):
            return ListingReader(source, budget)

    return Listing


def _path(*names: str):
    def get(x):
        for n in names:
            x = x.get(n) if isinstance(x, dict) else None
        return x

    return get


#: Job boards: where a payload keeps its jobs, and where a job keeps each field.
BOARDS: dict[str, dict] = {
    "greenhouse": {"jobs": "$.jobs", "id": ["$.id"], "title": ["$.title"], "body": ["$.content"], "location": ["$.location.name"], "published": ["$.updated_at"], "employment": [], "employer": [], "url": "https://job-boards.greenhouse.io/{slug}/jobs/{id}"},
    "lever": {"jobs": "$", "id": ["$.id"], "title": ["$.text"], "body": ["$.descriptionPlain", "$.description"], "location": ["$.categories.location"], "published": ["$.createdAt"], "employment": ["$.categories.commitment"], "employer": [], "url": "https://jobs.lever.co/{slug}/{id}"},
    "ashby": {"jobs": "$.jobs", "id": ["$.id"], "title": ["$.title"], "body": ["$.descriptionPlain", "$.descriptionHtml"], "location": ["$.location"], "published": ["$.publishedAt"], "employment": ["$.employmentType"], "employer": [], "url": "https://jobs.ashbyhq.com/{slug}/{id}"},
    "smartrecruiters": {"jobs": "$.content", "id": ["$.id"], "title": ["$.name"], "body": [], "location": ["$.location.city", "$.location.region", "$.location.country"], "published": ["$.releasedDate"], "employment": ["$.typeOfEmployment.label"], "employer": ["$.company.name"], "url": "https://jobs.smartrecruiters.com/{slug}/{id}"},
}


def board_key(text: Column) -> Column:
    """struct(provider, slug) of a declaration provider:slug; null if it is none."""
    parts = F.split(F.trim(text), ":", 2)
    provider = F.lower(F.get(parts, F.lit(0)))
    ok = (F.size(parts) == 2) & provider.isin(list(BOARDS)) & F.get(parts, F.lit(1)).rlike("^[A-Za-z0-9._-]+$")
    return F.when(ok, F.struct(provider.alias("provider"), F.get(parts, F.lit(1)).alias("slug")))


def board_postings(payloads: DataFrame, provider: str) -> DataFrame:
    """Rows of one provider's payloads (slug, payload as JSON text) in the shape common to all boards."""
    spec = BOARDS[provider]
    jobs = F.try_variant_get(F.try_parse_json("payload"), spec["jobs"], "array<variant>")
    rows = payloads.select("slug", F.explode(jobs).alias("job"))

    def all_of(paths: list[str], separator: str) -> Column:
        return F.array_join(F.filter(F.array(*[F.coalesce(parsers.text_at(F.col("job"), p), F.lit("")) for p in paths] or [F.lit("")]), lambda x: x != ""), separator)

    number, location = all_of(spec["id"], ""), all_of(spec["location"], ", ")
    url = F.lit(spec["url"])
    for name, value in (("slug", F.col("slug")), ("id", F.url_encode(number))):
        url = F.replace(url, F.lit("{" + name + "}"), value)
    remote = location.rlike("(?i)remote") | F.coalesce(F.try_variant_get("job", "$.isRemote", "boolean"), F.lit(False))
    out = rows.select(
        F.concat_ws(":", F.lit(provider), "slug", number).alias("source_id"), url.alias("url"), all_of(spec["title"], "").alias("title"),
        t.html_text(all_of(spec["body"], "\n")).alias("description"), F.coalesce(F.nullif(all_of(spec["employer"], ""), F.lit("")), F.col("slug")).alias("employer"),
        location.alias("location"), all_of(spec["published"], "").alias("published_at"), all_of(spec["employment"], "").alias("employment"), remote.alias("remote"), number.alias("id"),
    )
    return out.filter((F.col("id") != "") & (F.col("title") != "")).drop("id")


def all_boards(payloads: DataFrame) -> DataFrame:
    """payloads: provider, slug, payload."""
    parts = [board_postings(payloads.filter(F.col("provider") == p), p) for p in BOARDS]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def company_pages(pages: DataFrame, tag: str = "main", minimum: int = 20) -> DataFrame:
    """url, title (first h1), description (of the tag) and status of company listing pages."""
    title = t.html_text(F.regexp_extract("html", r"(?is)<h1\b[^>]*>(.*?)</h1>", 1))
    body = t.html_text(F.regexp_extract("html", rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1))
    out = pages.withColumns({"title": title, "description": body})
    ok = (F.col("title") != "") & (F.length("description") >= minimum)
    return out.select("url", "title", "description", F.when(ok, "ok").otherwise("invalid").alias("status"))


def posting_pages(pages: DataFrame, now) -> DataFrame:
    """Postings of pages with linked data: the one titled as the listing, else the only one.  pages: url, title, html."""
    found = pages.select("url", "title", parsers.postings("html").alias("found"))
    named = F.filter("found", lambda x: t.plain_text(F.get_json_object(x, "$.title")) == F.col("title"))
    one = F.when(F.size(named) > 0, named[0]).when(F.size("found") == 1, F.col("found")[0])
    return found.select("url", one.alias("posting")).filter("posting IS NOT NULL").select("url", parsers.vacancy(F.try_parse_json("posting"), now).alias("v")).select("url", "v.*")


def anchors(html: Column, base: str) -> Column:
    """Links of a page: array of struct(url, title), relative addresses joined to the base."""
    link = r'(?is)<a\b[^>]*href=["\']([^"\'#]+)["\'][^>]*>(.*?)</a>'
    urls, texts = (F.regexp_extract_all(html, F.lit(link), F.lit(k)) for k in (1, 2))
    whole = F.transform(urls, lambda u: F.when(u.rlike("^https?://"), u).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.ltrim(u, F.lit("/")))))
    pairs = F.arrays_zip(whole.alias("url"), F.transform(texts, lambda x: t.html_text(x)).alias("title"))
    return F.filter(pairs, lambda x: x["title"] != "")


class Registry:
    """Sources in the order they were added; hosts of a source only grow; closing twice is harmless."""

    def __init__(self):
        self.sources: dict[str, PageSource] = {}
        self.hosts: dict[str, set[str]] = {}
        self.closed = False

    def add(self, source: PageSource, hosts=()) -> None:
        if self.closed or source.name in self.sources:
            raise ValueError(f"cannot add source {source.name}")
        self.sources[source.name] = source
        self.allow(source.name, hosts)

    def allow(self, name: str, hosts) -> None:
        self.hosts.setdefault(name, set()).update(h.lower() for h in hosts)

    def close(self) -> None:
        self.closed = True

    def host_rows(self, spark: SparkSession) -> DataFrame:
        rows = [(n, sorted(self.hosts.get(n, ()))) for n in self.sources]
        return spark.createDataFrame(rows, "source string, hosts array<string>")


def after(rows: DataFrame, key: str, last, k: int) -> DataFrame:
    """One keyset page: k rows after the last key."""
    return (rows if last is None else rows.filter(F.col(key) > last)).orderBy(key).limit(k)


def export_user(spark: SparkSession, user, tables: dict[str, DataFrame], key: str = "user_id") -> DataFrame:
    """All rows of one user as one JSON object with a list for each table."""
    parts = []
    for name, df in tables.items():
        rows = df.filter(F.col(key) == user)
        parts.append(rows.select(F.lit(name).alias("name"), F.to_json(F.struct(*rows.columns)).alias("row")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    lists = out.groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("row")), ",").alias("rows"))
    return lists.select("name", F.concat(F.lit("["), "rows", F.lit("]")).alias("json"))


def ready(spark: SparkSession, names) -> dict[str, bool]:
    """Which of the tables exist."""
    return {n: spark.catalog.tableExists(n) for n in names}


def require_empty(spark: SparkSession, database: str) -> None:
    """Refuse to set up a database that has tables already."""
    if spark.catalog.listTables(database):
        raise ValueError(f"{database} is not empty")



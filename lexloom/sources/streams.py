"""Paged listings as a stream: cursors are followed, pages land once, offsets count landed pages.

A trigger fetches at most a budget of pages, shared evenly by the searches that have not ended.  A page
lands in a folder with the cursor that led to it and the one that follows, under its number; that folder
is the source's memory, so a query that starts again knows where each search stands before Spark tells it, and
a page that landed before a failure is not fetched again.  Executors read the landed pages of a batch, one
partition for each page; rows never pass the driver.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .readers import LISTING, PageSource, Search, allocations


@dataclass
class Landed(InputPartition):
    path: str
    search: str
    first: int


class Landing:
    """Pages of all searches under one folder: <search>/<number>.json, each written under another name first."""

    def __init__(self, folder: str):
        self.files, self.root = fs.FileSystem.from_uri(folder)

    def path(self, search: Search, number: int) -> str:
        return f"{self.root}/{quote(search.name, safe='')}/{number:08d}.json"

    def pages(self, search: Search) -> int:
        where = fs.FileSelector(f"{self.root}/{quote(search.name, safe='')}", allow_not_found=True)
        return sum(x.base_name.endswith(".json") for x in self.files.get_file_info(where))

    def read(self, path: str) -> dict:
        with self.files.open_input_stream(path) as f:
            return json.loads(f.read())

    def write(self, search: Search, number: int, page: dict) -> None:
        path = self.path(search, number)
        self.files.create_dir(path.rsplit("/", 1)[0])
        with self.files.open_output_stream(f"{path}.part") as f:
            f.write(json.dumps(page).encode())
        self.files.move(f"{path}.part", path)


class PageStream(DataSourceStreamReader):
    """Offsets are the numbers of landed pages by search."""

    def __init__(self, source: PageSource, folder: str, budget: int):
        self.source, self.landing, self.budget = source, Landing(folder), budget
        self.at: dict[str, tuple[int, str | None, set, bool]] | None = None  # pages, next cursor, cursors met, ended

    def initialOffset(self) -> dict:
        return {s.name: 0 for s in self.source.searches}

    def _found(self, search: Search) -> tuple[int, str | None, set, bool]:
        """Where a search stands by its landed pages."""
        n = self.landing.pages(search)
        held = [self.landing.read(self.landing.path(search, k)) for k in range(n)]
        met = {x["cursor"] for x in held}
        following = held[-1]["next"] if held else None
        return n, following, met, bool(held) and (not following or following in met or self._most(n))

    def _most(self, n: int) -> bool:
        return self.source.max_pages is not None and n >= self.source.max_pages

    def latestOffset(self) -> dict:
        if self.at is None:
            self.at = {s.name: self._found(s) for s in self.source.searches}
        going = [s for s in self.source.searches if not self.at[s.name][3]]
        for search, share in zip(going, allocations(len(going), self.budget, self.source.max_pages) if going else [], strict=True):
            n, cursor, met, ended = self.at[search.name]
            for _ in range(share):
                if ended:
                    break
                rows, following = self.source.read(self.source.fetch(search, cursor))
                self.landing.write(search, n, {"cursor": cursor, "next": following, "rows": list(rows)})
                met, n = met | {cursor}, n + 1
                ended = not following or following in met or self._most(n)
                cursor = following
            self.at[search.name] = n, cursor, met, ended
        return {name: x[0] for name, x in self.at.items()}

    def partitions(self, start: dict, end: dict) -> list[Landed]:
        return [Landed(self.landing.path(s, k), s.name, k << 32) for s in self.source.searches for k in range(start.get(s.name, 0), end.get(s.name, 0))]

    def read(self, partition: Landed) -> Iterator[tuple]:
        for k, x in enumerate(self.landing.read(partition.path)["rows"]):
            yield (self.source.name, str(x["id"]), x.get("url"), x.get("title"), x.get("summary"), x.get("published_at"), partition.search, partition.first + k)

    def commit(self, end: dict) -> None:
        """Landed pages stay: they are the memory of the searches."""


def stream_source(provider: str, source: PageSource, folder: str, budget: int) -> type[DataSource]:
    """A data source of that name for spark.readStream.format; folder: a URI that driver and executors share; budget: pages of a trigger."""

    class Listing(DataSource):
        @classmethod
        def name(cls):
            return provider

        def schema(self):
            return LISTING

        def streamReader(self, schema):
            return PageStream(source, folder, budget)

    return Listing

"""Saved provider responses as a data source: `spark.read.format("search_results")` and `spark.readStream`.

    spark.dataSource.register(SearchResults)
    spark.read.format("search_results").option("provider", "rss").load("s3a://bucket/responses")

One row per listed result: response (file name), position, title and url as the provider wrote them, error null. A response
that cannot be read, or is larger than `MAX_BYTES`, is one row with its error and neither title nor url. `discovered` makes them the
rows that the parsers of `feeds` give; `failed` keeps the dead letters.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from folioforge.sources import feeds

PARTITION_BYTES = 64 << 20
FILE_BYTES = 64 << 10  # what opening a file counts as


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _feed(body: bytes) -> Iterator[tuple[str | None, str | None]]:
    root = ElementTree.fromstring(body)
    for node in root.iter():
        if _local(node.tag) not in ("item", "entry"):
            continue
        title = link = None
        for child in node:
            name = _local(child.tag)
            if name == "title" and title is None:
                title = "".join(child.itertext())
            elif name == "link" and link is None and child.get("rel", "alternate") == "alternate":
                link = child.get("href") or child.text
        yield title, link


def _listed(results: object) -> Iterator[tuple[str | None, str | None]]:
    if not isinstance(results, list):
        raise ValueError("no list of results")
    for r in results:
        if isinstance(r, dict):
            yield r.get("title"), r.get("url")


def _brave(body: bytes) -> Iterator[tuple[str | None, str | None]]:
    return _listed(json.loads(body)["web"]["results"])


def _duckduckgo(body: bytes) -> Iterator[tuple[str | None, str | None]]:
    found = json.loads(body)
    return _listed(json.loads(found) if isinstance(found, str) else found)


RESULTS = {"rss": _feed, "brave": _brave, "duckduckgo": _duckduckgo}


@dataclass
class Responses(InputPartition):
    """Files that one task reads: (path, bytes) each."""

    files: list[tuple[str, int]]


def _files(path: str) -> list[tuple[int, str, int]]:
    """(time written, path, bytes) of the responses in a folder, in that order; names that begin with . or _ are not listed."""
    import pyarrow.fs as fs

    store, root = fs.FileSystem.from_uri(path)
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted((f.mtime_ns, f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")


def _dealt(files: list[tuple[str, int]]) -> list[InputPartition]:
    parts: list[InputPartition] = []
    held, size = [], 0
    for name, n in files:
        cost = max(n, FILE_BYTES)
        if held and size + cost > PARTITION_BYTES:
            parts.append(Responses(held))
            held, size = [], 0
        held.append((name, n))
        size += cost
    return [*parts, Responses(held)] if held else parts


class _Reads:
    def __init__(self, options: dict):
        self.provider, self.path = options.get("provider", "rss"), options.get("path")
        if self.provider not in RESULTS:
            raise ValueError(f"unknown provider {self.provider}")
        if not self.path:
            raise ValueError("no path of saved responses")
        if ":/" not in self.path:
            self.path = "file://" + self.path

    def rows(self, part: Responses | None) -> Iterator[tuple]:
        import pyarrow.fs as fs

        if part is None:  # an empty folder has no partitions
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        for name, size in part.files:
            response = name.rsplit("/", 1)[-1]
            try:
                if size > feeds.MAX_BYTES:
                    raise ValueError(f"{size} bytes")
                with store.open_input_stream(name) as f:
                    rows = list(RESULTS[self.provider](f.read()))
            except (ValueError, KeyError, TypeError, ElementTree.ParseError) as e:
                yield response, None, None, None, f"{type(e).__name__}: {e}"
                continue
            text = lambda x: x if isinstance(x, str) else None
            for at, (title, url) in enumerate(rows):
                yield response, at, text(title), text(url), None


class _Batch(_Reads, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return _dealt([(p, n) for _, p, n in _files(self.path)])

    def read(self, partition: Responses) -> Iterator[tuple]:
        return self.rows(partition)


class _Stream(_Reads, DataSourceStreamReader):
    """Offsets are (time written, path) of the last response. A response counts once `settle` seconds have passed since it was
    written, so that one listed late, but written before another, is not jumped over. Responses must be written in place or
    renamed: one that is copied in later with an old time of writing isn't read."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.settle = float(options.get("settle", 5))
        self.done = self.initialOffset()

    def _ready(self) -> list[tuple[int, str, int]]:
        until = time.time_ns() - int(self.settle * 1e9)
        return [f for f in _files(self.path) if f[0] <= until]

    def initialOffset(self) -> dict:
        return {"written": 0, "path": ""}

    def latestOffset(self) -> dict:
        ready = self._ready()
        if ready:
            self.done = max(self.done, {"written": ready[-1][0], "path": ready[-1][1]}, key=lambda o: (o["written"], o["path"]))
        return self.done

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        after, until = (start["written"], start["path"]), (end["written"], end["path"])
        return _dealt([(p, n) for at, p, n in _files(self.path) if after < (at, p) <= until])

    def read(self, partition: Responses) -> Iterator[tuple]:
        return self.rows(partition)

    def commit(self, end: dict) -> None:
        """Nothing to give up: responses stay in their folder."""


class SearchResults(DataSource):
    @classmethod
    def name(cls) -> str:
        return "search_results"

    def schema(self) -> str:
        return "response string, position int, title string, url string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SearchResults)


def discovered(found: DataFrame, unique: bool = True) -> DataFrame:
    """response, position, title, url of rows with a title and a fetchable address, as the parsers of `feeds` give them; with
    unique, the first row of each address in its response (feeds are not made unique: repeats are found against the catalog)."""
    rows = feeds.listed(found.filter("error IS NULL").select("response", "position", "title", "url"))
    if not unique:
        return rows
    return rows.groupBy("response", "url").agg(F.min(F.struct("position", "title")).alias("r")).select("response", "r.position", "r.title", "url")


def failed(found: DataFrame) -> DataFrame:
    """response, error of what could not be read."""
    return found.filter("error IS NOT NULL").select("response", "error")

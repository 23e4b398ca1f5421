"""Cursor-paged sources as a Spark data source: a stream whose offset is the cursor of the next page.

A fetcher of any kind lands a page as two files named by the digest of the page's cursor: its payload (a JSON array of
items), then its head, a small JSON object that says what the payload is and which cursor follows. The driver walks heads
from cursor to cursor and never opens a payload; tasks read payloads, some pages each, and hold them against their heads.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidewatch.operators import commits

#: Rows of the source: an item as JSON with its page's number from 0, its position there, and the page's receipt.
SCHEMA = "page bigint, position bigint, item string, cursor string, dataset string, provider string, source_id string, fetch_id string, payload_sha256 string, fetched_at string"
#: Fields of an item that must be as its page's receipt has them, and limits of a run.
RECEIPT = ("dataset", "provider", "source_id", "fetch_id", "payload_sha256", "fetched_at")
MAX_PAGES, MAX_EMPTY = 10_000, 10
LANDED = "cursor string, following string, payload string, dataset string, provider string, source_id string, fetch_id string, fetched_at string"


class BackfillError(RuntimeError):
    """A run that can't go on: its state says why."""


def canonical(cursor: Mapping | str) -> str:
    """A cursor as text that is the same for the same cursor."""
    value = json.loads(cursor) if isinstance(cursor, str) else dict(cursor)
    if not isinstance(value, dict) or not value:
        raise ValueError("a cursor is an object with a field at least")
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def job_key(provider: str, dataset: str, schema_version: str, start: str, end: str, interval_seconds: int) -> str:
    """The name of a backfill: the same source, version and window are the same job."""
    if end <= start or interval_seconds <= 0:
        raise ValueError("a window ends after it starts and has a positive interval")
    parts = {"provider": provider, "dataset": dataset, "schema_version": schema_version, "window": {"start": start, "end": end, "interval_seconds": interval_seconds}}
    return "backfill:sha256:" + sha256(json.dumps(parts, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _name(cursor: str) -> str:
    return sha256(cursor.encode()).hexdigest()


def _put(files, name: str, content: bytes) -> None:
    """The whole file or none: written beside, then moved."""
    with files.open_output_stream(f"{name}.part") as out:
        out.write(content)
    files.move(f"{name}.part", name)


def _get(files, name: str) -> bytes | None:
    try:
        with files.open_input_stream(name) as found:
            return found.read()
    except FileNotFoundError:
        return None


def land(pages: DataFrame, path: str) -> int:
    """Lands pages (columns of LANDED; `following` is null for the last one, cursors and payloads are JSON) in the folder
    `path`: how many. Tasks write them; a page that lands again takes the place of the first one, whole."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        files, root = _files(path)
        files.create_dir(root)
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                cursor, body = canonical(r.cursor), r.payload.encode()
                last = r.following is None
                head = {"cursor": cursor, "following": None if last else canonical(r.following), "completed": last, "rows": len(json.loads(body)), "payload_sha256": sha256(body).hexdigest()}
                head |= {k: getattr(r, k) for k in ("dataset", "provider", "source_id", "fetch_id", "fetched_at")}
                _put(files, f"{root}/{_name(cursor)}.json", body)
                _put(files, f"{root}/{_name(cursor)}.head", json.dumps(head).encode())
            yield pd.DataFrame({"n": [len(pdf)]})

    names = [c.split()[0] for c in LANDED.split(", ")]
    return pages.select(*names).mapInPandas(run, "n bigint").agg({"n": "sum"}).first()[0] or 0


class _Walk:
    """Heads from a first cursor on, as far as they are there. `problem` says why the walk goes no further: LOOP (a cursor
    that was met before), EMPTY (more empty pages in a row than allowed), PAGES (as many pages as allowed, and no end),
    INVALID (a head of another cursor, or one whose end and following cursor contradict each other)."""

    def __init__(self, path: str, initial: str, max_pages: int, max_empty: int):
        self.files, self.root = _files(path)
        self.cursor: str | None = canonical(initial)
        self.heads: list[dict] = []
        self.met = {self.cursor}
        self.max_pages, self.max_empty, self.empty = max_pages, max_empty, 0
        self.completed, self.problem = False, None

    def on(self) -> _Walk:
        while not self.completed and not self.problem:
            found = _get(self.files, f"{self.root}/{_name(self.cursor)}.head")
            if found is None:
                break
            if len(self.heads) >= self.max_pages:
                self.problem = "PAGES"
                break
            head = json.loads(found)
            follows = head.get("following")
            if head.get("cursor") != self.cursor or bool(head.get("completed")) != (follows is None) or head.get("rows", -1) < 0:
                self.problem = "INVALID"
                break
            empty = 0 if head["rows"] else self.empty + 1
            if empty > self.max_empty:
                self.problem = "EMPTY"
                break
            if follows in self.met:
                self.problem = "LOOP"
                break
            self.empty = empty
            self.heads.append(head)
            self.completed, self.cursor = follows is None, follows
            self.met.add(follows)
        return self

    def offset(self) -> dict:
        return {"page": len(self.heads), "cursor": self.cursor or ""}


class _Pages(InputPartition):
    def __init__(self, first: int, heads: list[dict]):
        self.first, self.heads = first, heads


class _Reader(DataSourceStreamReader):
    def __init__(self, options: Mapping[str, str]):
        self.path, self.initial = options["path"], options["initial"]
        self.share = int(options.get("pagespertask", 8))
        self.limits = int(options.get("maxpages", MAX_PAGES)), int(options.get("maxempty", MAX_EMPTY))
        self.walk = None

    def _walked(self) -> _Walk:
        self.walk = self.walk or _Walk(self.path, self.initial, *self.limits)
        return self.walk.on()

    def initialOffset(self) -> dict:
        return {"page": 0, "cursor": canonical(self.initial)}

    def latestOffset(self) -> dict:
        return self._walked().offset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        heads = self._walked().heads
        for at in (start, end):
            cursor = heads[at["page"]]["cursor"] if at["page"] < len(heads) else self.walk.cursor or ""
            if at["page"] > len(heads) or cursor != at["cursor"] and at["cursor"]:
                raise BackfillError(f"landed pages are not those of the checkpoint at page {at['page']}")
        return [_Pages(k, heads[k : min(k + self.share, end["page"])]) for k in range(start["page"], end["page"], self.share)]

    def read(self, partition: _Pages) -> Iterator[tuple]:
        files, root = _files(self.path)
        for page, head in enumerate(partition.heads, partition.first):
            body = _get(files, f"{root}/{_name(head['cursor'])}.json")
            if body is None or sha256(body).hexdigest() != head["payload_sha256"]:
                raise BackfillError(f"the payload of page {page} is not the one that its head names")
            items = json.loads(body)
            if len(items) != head["rows"]:
                raise BackfillError(f"page {page} has other rows than its head says")
            receipt = [head[k] for k in RECEIPT]
            for position, item in enumerate(items):
                if isinstance(item, dict) and any(k in item and item[k] != head[k] for k in RECEIPT):
                    raise BackfillError(f"item {position} of page {page} is not of the page's receipt")
                yield page, position, json.dumps(item, ensure_ascii=False), head["cursor"], *receipt


class PagedSource(DataSource):
    """`spark.readStream.format("pages")`: option `path` is the folder, `initial` the first cursor as JSON, `maxPages`,
    `maxEmpty`, `pagesPerTask` as their names say."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options)


def pages(spark: SparkSession, path: str, initial: Mapping | str, max_pages: int = MAX_PAGES, max_empty: int = MAX_EMPTY, pages_per_task: int = 8) -> DataFrame:
    """A stream of the items of the pages in `path`, columns of SCHEMA, from the page of the cursor `initial` on."""
    if max_pages < 1 or max_empty < 0:
        raise ValueError("max_pages must be positive, max_empty not negative")
    spark.dataSource.register(PagedSource)
    options = {"path": path, "initial": canonical(initial), "maxPages": max_pages, "maxEmpty": max_empty, "pagesPerTask": pages_per_task}
    return spark.readStream.format("pages").options(**options).load()


def progress(path: str, initial: Mapping | str, max_pages: int = MAX_PAGES, max_empty: int = MAX_EMPTY) -> dict:
    """pages, rows, completed, next (a cursor), problem of what has landed."""
    walk = _Walk(path, canonical(initial), max_pages, max_empty).on()
    return {"pages": len(walk.heads), "rows": sum(h["rows"] for h in walk.heads), "completed": walk.completed, "next": walk.cursor, "problem": walk.problem}


def backfill(spark: SparkSession, landed: str, path: str, initial: Mapping | str, rows: Callable[[DataFrame], DataFrame], key: str | None = None, max_pages: int = MAX_PAGES, max_empty: int = MAX_EMPTY) -> dict:
    """Commits `rows(items)` of all pages that have landed since the last run to the sink at `path`, each page once: the
    `progress` of the source. Pages before a problem are committed, then it is an error; a run after more has landed, or
    after a crash, goes on at the cursor where the last commit stood. A completed job runs again without an effect."""
    stream = rows(pages(spark, landed, initial, max_pages, max_empty))
    query = stream.writeStream.foreachBatch(commits.sink(path, "pages", key)).option("checkpointLocation", f"{path}/_stream").trigger(availableNow=True).start()
    query.awaitTermination()
    state = progress(landed, initial, max_pages, max_empty)
    if state["problem"]:
        raise BackfillError(f"{state['problem']} after {state['pages']} pages")
    return state

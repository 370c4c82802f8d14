"""Feeds in and out: JSON records and summaries, plugin lines, and a change feed as a data source."""

from __future__ import annotations

import heapq
import json
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from skeinery.functions import text as T

RECORD = "id string, name string, total_size bigint, files array<struct<path:string,size:bigint>>, first_seen bigint, last_seen bigint, seen_count bigint"


def record_json(prefix: str = "") -> Column:
    """A record as one JSON object; fields without a value are left out."""
    names = [f.split(" ")[0] for f in RECORD.split(", ")]
    return F.to_json(F.struct(*(F.col(prefix + n).alias(n) for n in names)), {"ignoreNullFields": "true"})


def parsed_records(lines: DataFrame, column: str = "value") -> DataFrame:
    """Records from JSON lines; a line that is no record gives nulls and is left out."""
    return lines.select(F.from_json(column, RECORD).alias("r")).where("r.id is not null").select("r.*")


def search_item() -> Column:
    """A summary as the search endpoint shows it: seeds -1 where unknown, a magnet link."""
    fields = [
        F.col("id").alias("infohash"), "name", F.col("total_size").alias("size"), F.coalesce("peer_count", F.lit(-1)).alias("seeds"), F.lit(-1).alias("leech"),
        F.col("file_count").alias("files"), F.col("last_seen").alias("pub_date"), "category", T.magnet(F.col("id"), F.col("name")).alias("magnet"),
    ]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "true"})


def plugin_line(engine_url: str) -> Column:
    """``link|name|size|seeds|leech|engine_url|pub_date`` without pipes inside the name; a missing number is -1, a missing name empty."""
    name = F.replace(F.coalesce("name", F.lit("")), F.lit("|"), F.lit(" "))
    number = lambda c: F.coalesce(F.col(c), F.lit(-1)).cast("string")
    return F.concat_ws("|", T.magnet(F.col("id"), F.col("name")), name, number("total_size"), number("peer_count"), F.lit("-1"), F.lit(engine_url), number("last_seen"))


def stats_envelope(overview: DataFrame) -> DataFrame:
    return overview.select(F.to_json(F.struct("*")).alias("stats"))


def fetch_page(url: str, cursor: int, limit: int, token: str = "") -> dict:
    """One page of a change feed: ``{"records": [...], "cursor": n, "more": bool}``.

    ``http(s)`` feeds are asked with ``since`` and ``limit`` and a bearer token;
    any other place is a JSON file holding all changes, each with its ``seq``.
    """
    if url.startswith(("http://", "https://")):
        request = urllib.request.Request(f"{url}?{urllib.parse.urlencode({'since': cursor, 'limit': limit})}", headers={"Authorization": f"Bearer {token}"} if token else {})
        with urllib.request.urlopen(request, timeout=30) as answer:
            return json.load(answer)
    with open(url.removeprefix("file://"), encoding="utf-8") as f:  # one more than the page, so no more than that is held
        page = heapq.nsmallest(limit + 1, (r for r in map(json.loads, f) if r["seq"] > cursor), key=lambda r: r["seq"])
    more = len(page) > limit
    page = page[:limit]
    return {"records": page, "cursor": page[-1]["seq"] if page else cursor, "more": more}


FIELDS = ("id", "name", "total_size", "files", "first_seen", "last_seen", "seen_count")
SCHEMA = "id string, name string, total_size bigint, files array<struct<path:string,size:bigint>>, first_seen bigint, last_seen bigint, seen_count bigint, seq bigint"


def _row(r: dict) -> tuple:
    files = [(f.get("path"), f.get("size")) for f in r.get("files") or []]
    return (*(files if n == "files" else r.get(n) for n in FIELDS), r.get("seq"))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.token = options["url"], options.get("token", "")
        self.since, self.limit = int(options.get("since", 0)), min(max(int(options.get("limit", 500)), 1), 1000)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        cursor, more = self.since, True
        while more:
            page = fetch_page(self.url, cursor, self.limit, self.token)
            yield from map(_row, page["records"])
            more = page["more"] and page["cursor"] > cursor
            cursor = page["cursor"]


class _Stream(SimpleDataSourceStreamReader):
    """Offsets are cursors; a page is replayed from its start after a failure."""

    def __init__(self, options: dict):
        self.url, self.token = options["url"], options.get("token", "")
        self.limit = min(max(int(options.get("limit", 500)), 1), 1000)

    def initialOffset(self) -> dict:
        return {"seq": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        page = fetch_page(self.url, start["seq"], self.limit, self.token)
        return map(_row, page["records"]), {"seq": page["cursor"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        page = fetch_page(self.url, start["seq"], 1000, self.token)
        return (_row(r) for r in page["records"] if r["seq"] <= end["seq"])


class ChangeFeed(DataSource):
    """``format("skeinery_changes")`` with options url, token, since, limit."""

    @classmethod
    def name(cls) -> str:
        return "skeinery_changes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ChangeFeed)

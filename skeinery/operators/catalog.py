"""The catalogue: views over its tables, point lookup, browsing with filters, sorting and paging, change feed."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinery.functions import text as T
from skeinery.functions.wordlists import CATEGORIES
from skeinery.session import materialize
from skeinery.sources.tables import table

SUMMARY = ["id", "name", "total_size", "file_count", "first_seen", "last_seen", "seen_count", "peer_count", "category", "fetched"]


def records(spark: SparkSession, directory: str) -> DataFrame:
    """One row for each id: copies agree in name and files, counters are merged by min, max and max."""
    t = table(spark, directory, "torrents")
    return t.groupBy("id").agg(
        F.max("name").alias("name"),
        F.coalesce(F.max("total_size"), F.lit(0)).alias("total_size"),
        F.max("files").alias("files"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.max("seen_count").alias("seen_count"),
    )


def states(spark: SparkSession, directory: str) -> DataFrame:
    """The latest state of each id."""
    s = table(spark, directory, "torrent_state")
    newest = Window.partitionBy("id").orderBy(F.desc("last_seen"), F.desc("seen_count"))
    return s.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def items(spark: SparkSession, directory: str) -> DataFrame:
    """Records with their state: the table that browsing and dashboards read.

    ``peer_count`` is null where peers were never probed, ``fetched`` says
    whether metadata is there.
    """
    r = records(spark, directory)
    s = states(spark, directory).select("id", "metadata_status", "probe_peers", "probe_at")
    joined = r.join(s, "id", "left")
    return joined.select(
        "id",
        F.coalesce("name", F.lit("")).alias("name"),
        "total_size",
        F.when(F.col("files").isNull(), 0).otherwise(F.size("files")).cast("bigint").alias("file_count"),
        "first_seen",
        "last_seen",
        "seen_count",
        F.coalesce("metadata_status", F.lit("pending")).alias("metadata_status"),
        F.when(F.col("probe_peers") >= 0, F.col("probe_peers")).alias("peer_count"),
        F.when(F.col("probe_at") > 0, F.col("probe_at")).alias("last_check"),
        T.category(F.col("name"), F.col("files")).alias("category"),
        T.garbled(F.coalesce("name", F.lit(""))).alias("garbled"),
        (F.coalesce("metadata_status", F.lit("pending")) == "fetched").alias("fetched"),
        "files",
    )


def files(spark: SparkSession, directory: str) -> DataFrame:
    """Child table ``id, ord, path, size``; a null size counts 0."""
    r = records(spark, directory).select("id", F.posexplode("files").alias("ord", "f"))
    return r.select("id", "ord", F.col("f.path").alias("path"), F.coalesce("f.size", F.lit(0)).alias("size"))


@dataclass(frozen=True)
class Filter:
    """What a caller may narrow a listing by; all parts are joined by AND."""

    only_alive: bool = False
    hide_adult: bool = False
    hide_garbled: bool = False
    category: str | None = None
    block: list[str] = field(default_factory=list)

    def column(self) -> Column:
        c = F.lit(True)
        if self.only_alive:
            c = c & (F.col("peer_count") > 0)
        if self.hide_adult:
            c = c & (F.col("category") != "adult")
        if self.hide_garbled:
            c = c & ~F.col("garbled")
        if self.category:
            c = c & (F.col("category") == self.category)
        for word in self.block:
            if w := word.strip().lower():
                c = c & ~F.contains(F.lower("name"), F.lit(w))
        return c


SORT_KEYS = {"name": "name", "cat": "category", "size": "total_size", "seed": "peer_count", "files": "file_count", "date": "last_seen", "added": "first_seen", "seen": "seen_count"}


def sort_order(key: str = "", descending: bool = False) -> list[Column]:
    """Total order of a listing; an unknown key means relevance.

    Nulls count as the smallest.  The name within a category is always
    ascending, the id breaks ties.
    """
    turn = (lambda c: c.desc_nulls_last()) if descending else (lambda c: c.asc_nulls_first())
    if key not in SORT_KEYS:
        return [F.col("seen_count").desc(), F.col("last_seen").desc(), F.col("id").asc()]
    if key == "name":
        return [turn(F.lower("name")), F.col("id").asc()]
    if key == "cat":
        return [turn(F.lower("category")), F.lower("name").asc(), F.col("id").asc()]
    return [turn(F.col(SORT_KEYS[key])), F.col("id").asc()]


def candidate_order(key: str, descending: bool) -> list[Column]:
    """Order of already ranked candidates: the whole comparison turns round, names within a category too."""
    turn = (lambda c: c.desc_nulls_last()) if descending else (lambda c: c.asc_nulls_first())
    if key == "cat":
        return [turn(F.lower("category")), turn(F.lower("name")), F.col("id").asc()]
    return sort_order(key, descending)


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(max(offset, 0)).limit(max(limit, 0))


def browse(rows: DataFrame, *, limit: int, offset: int = 0, sort: str = "", descending: bool = False, keep: Filter | None = None) -> DataFrame:
    """One page of the fetched items as summaries."""
    kept = rows.where(F.col("fetched") & (keep or Filter()).column())
    return page(kept, sort_order(sort, descending), limit, offset).select(*SUMMARY)


def top_by(rows: DataFrame, key: str, limit: int, keep: Filter | None = None) -> DataFrame:
    return browse(rows, limit=limit, sort=key, descending=True, keep=keep)


def lookup(spark: SparkSession, directory: str, content_id: str) -> DataFrame:
    """One fetched record with its files in order; no row if there is none."""
    found = items(spark, directory).where((F.col("id") == content_id.lower()) & F.col("fetched"))
    return found.select(*SUMMARY, F.coalesce("files", F.array().cast("array<struct<path:string,size:bigint>>")).alias("files"))


def sequenced(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``seq``, the number each id got when it was first written.

    ``known`` (id, seq) holds the numbers given so far; they never change.  New
    ids follow after the largest, in order of first sighting and id, whenever
    they were first sighted, so a reader's cursor stays good.  Keep ``id, seq``
    of the result as the next ``known``.

    A sort by ranges and counts by range give the numbers; no single task sees
    all rows.  The ranges are written once, as both steps must see the same.
    """
    last, new = 0, rows
    if known is not None:
        known = known.select("id", "seq")
        last = known.agg(F.max("seq")).first()[0] or 0
        new = rows.join(known, "id", "left_anti")
    spread = materialize(new.repartitionByRange("first_seen", "id").withColumn("_p", F.spark_partition_id()), "sequence")
    inside = Window.partitionBy("_p").orderBy("first_seen", "id")
    numbered = spread.withColumn("_r", F.row_number().over(inside))
    ends = spread.groupBy("_p").agg(F.count("*").alias("_n"))  # a row for each range
    starts = ends.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    fresh = numbered.join(starts, "_p").withColumn("seq", F.col("_r") + F.col("_s") + F.lit(last)).drop("_p", "_r", "_s")
    return fresh if known is None else rows.join(known, "id").select(*fresh.columns).unionByName(fresh)


def changes_since(rows: DataFrame, cursor: int, limit: int) -> DataFrame:
    """The next records after ``cursor`` in change order, at most 1000; the new cursor is the largest ``seq``."""
    n = min(max(limit, 1), 1000)
    return rows.where((F.col("seq") > cursor) & F.col("fetched")).orderBy("seq").limit(n)


def oldest_checked(rows: DataFrame, limit: int) -> DataFrame:
    """Fetched items whose liveness was checked longest ago, never checked first."""
    return rows.where("fetched").orderBy(F.col("last_check").asc_nulls_first(), "id").limit(limit).select("id", "last_check")


def known_category(name: str | None) -> str | None:
    return T.category_of_alias(name)


def largest_files(child: DataFrame, most: int = 48) -> DataFrame:
    """The ``most`` largest files of each record, in that order."""
    order = Window.partitionBy("id").orderBy(F.desc("size"), "ord")
    return child.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


__all__ = ["CATEGORIES", "Filter", "SUMMARY", "browse", "changes_since", "items", "lookup", "page", "records", "sort_order", "states", "top_by"]

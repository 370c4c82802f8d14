"""Queries over feeds and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinery.operators import analytics as A
from skeinery.operators import catalog as C
from skeinery.plans import oracle as O
from skeinery.plans import stores
from skeinery.plans.queries_analytics import ORACLE as A_SQL
from skeinery.sources import feeds

_SUMMARIES = f"WITH {O.ITEMS} SELECT id, coalesce(peer_count, -1) AS seeds, last_seen AS pub_date FROM items WHERE fetched"


def json_records(s, d):
    """Records written as JSON and read back."""
    lines = C.records(s, d).select(feeds.record_json().alias("value"))
    return feeds.parsed_records(lines).select("id", "name", "total_size", F.when(F.col("files").isNull(), 0).otherwise(F.size("files")).alias("n_files"), "seen_count")


def api_projection(s, d):
    items = stores.items(s, d).where("fetched").select(F.from_json(feeds.search_item(), "infohash string, seeds bigint, pub_date bigint").alias("j"))
    return items.select(F.col("j.infohash").alias("id"), "j.seeds", "j.pub_date")


QUERIES = {
    "json_records": json_records,
    "api_projection": api_projection,
    "plugin_lines": lambda s, d: stores.items(s, d).where("fetched AND name <> ''").select("id", feeds.plugin_line("http://localhost").alias("line")),
    "stats_envelope": lambda s, d: feeds.stats_envelope(A.overview(stores.items(s, d))),
}
_STATS = ["torrents", "total_size", "files", "peers", "alive", "dead", "unchecked", "known"]
ORACLE = {
    "stats_envelope": f"SELECT '{{' || " + " || ',' || ".join(f"'\"{c}\":' || {c}" for c in _STATS) + f" || '}}' AS stats FROM ({A_SQL['overview']})",
    "json_records": f"WITH {O.RECORDS} SELECT id, name, total_size, CASE WHEN files IS NULL THEN 0 ELSE len(files) END AS n_files, seen_count FROM recs",
    "api_projection": _SUMMARIES,
    "plugin_lines": f"WITH {O.ITEMS} SELECT id, concat_ws('|', 'magnet:?xt=urn:btih:' || id || '&dn=' || url_encode(name), replace(name, '|', ' '), total_size::VARCHAR, coalesce(peer_count, -1)::VARCHAR, '-1', 'http://localhost', last_seen::VARCHAR) AS line FROM items WHERE fetched AND name <> ''",
}

"""Explicit schemas of the tables and the constants that define behaviour."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILE = T.StructType([T.StructField("path", T.StringType()), T.StructField("size", T.LongType())])


def _table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


_L, _S, _I = T.LongType(), T.StringType(), T.IntegerType()

TABLES = {
    "torrents": _table(("id", _S), ("name", _S), ("total_size", _L), ("files", T.ArrayType(FILE)), ("first_seen", _L), ("last_seen", _L), ("seen_count", _L)),
    "torrent_state": _table(
        ("id", _S), ("metadata_status", _S), ("first_seen", _L), ("last_seen", _L), ("seen_count", _L), ("fetch_attempts", _I), ("last_attempt", _L),
        ("hot_seen", _L), ("hot_count", _I), ("hint_peers", _L), ("probe_peers", _L), ("probe_at", _L),
    ),
    "sightings": _table(("sighting_id", _L), ("infohash", _S), ("source", _S), ("peers", T.ArrayType(_S)), ("repeats", _L), ("seen_at", _L), ("arrived_at", T.TimestampNTZType())),
    "metric_log": _table(("name", _S), ("ts", _L), ("n", _L)),
    "torrent_embeddings": _table(("seq", _L), ("id", _S), ("model_id", _S), ("dim", _I), ("scale", T.FloatType()), ("q", T.ArrayType(T.ByteType()))),
    "embed_models": _table(("model_id", _S), ("dim", _I), ("min_score", T.DoubleType()), ("active", T.BooleanType())),
}

STATUSES = ["pending", "fetched", "unreachable"]
SOURCES = ["sample", "sample_peers", "get_peers", "announce"]
METRICS = [
    "triage_done", "triage_dead", "fetch_attempt", "fetch_ok", "fetch_ok_hinted", "dht_samples", "dht_announce", "dht_get_peers", "dht_queries_sent", "dht_rate_limited",
    "dht_responses", "dht_nodes_learned", "dht_dropped", "dht_sock_err", "engine_alive", "dht_duplicates", "dht_harvested",
]
#: Result pages: default and largest size, characters of a query that count.
PAGE_DEFAULT, PAGE_MOST, QUERY_MOST = 100, 500, 256
CHANGES_DEFAULT, CHANGES_MOST = 500, 1000


def empty(spark: SparkSession, name: str) -> DataFrame:
    """An empty table of the catalogue."""
    return spark.createDataFrame([], TABLES[name])


def conformed(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with exactly the columns of a table: missing ones null, others dropped, types cast."""
    have = set(rows.columns)
    return rows.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[name]))

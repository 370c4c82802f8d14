"""Streams run to their end over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinery.plans import oracle as O
from skeinery.plans.queries_analytics import _LOG
from skeinery.plans.queries_pipeline import _ROLL
from skeinery.streaming import streams as S


def stream_dedup(s, d):
    return S.distinct_batches(S.table_stream(s, d, "sightings").where("sighting_id is not null").select("sighting_id"))


def stream_metrics(s, d):
    return S.metric_batches(S.table_stream(s, d, "metric_log"))


def stream_rollup(s, d):
    return S.rollup_batches(S.table_stream(s, d, "sightings"))


def stream_fifo(s, d):
    rows = S.table_stream(s, d, "sightings").where("infohash is not null").select(F.lower("infohash").alias("id"), "sighting_id")
    out = s.read.parquet(S.run_to_end(S.fifo_deduplicated(rows, key="id", order="sighting_id", capacity=65_536, shards=16), "fifo"))
    return out.select(F.col("k").alias("id"), F.col("o").alias("sighting_id"), "is_new")


QUERIES = {"stream_dedup": stream_dedup, "stream_metrics": stream_metrics, "stream_rollup": stream_rollup, "stream_fifo": stream_fifo}
ORACLE = {
    "stream_dedup": "SELECT DISTINCT sighting_id FROM sightings WHERE sighting_id IS NOT NULL",
    "stream_metrics": f"WITH {_LOG} SELECT name, bucket, value FROM b",
    # while no shard holds more distinct keys than its capacity, new means first
    "stream_fifo": "SELECT lower(infohash) AS id, sighting_id, row_number() OVER (PARTITION BY lower(infohash) ORDER BY sighting_id) = 1 AS is_new FROM sightings WHERE infohash IS NOT NULL",
    "stream_rollup": f"WITH {O.SEEN} {_ROLL}",
}

"""The pipeline as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinery.functions import binary as B
from skeinery.operators import analytics as A
from skeinery.operators import pipeline as P
from skeinery.session import scratch


def table_stream(spark: SparkSession, directory: str, name: str, files_each: int = 1000) -> DataFrame:
    """A table as a stream of its files."""
    path = f"{directory}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    single = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isFile()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each)
    if single:  # a stream reads folders; the name picks the one file
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(directory)
    return reader.parquet(path)


def run_to_end(stream: DataFrame, label: str, *, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> str:
    """Process all that is there and stop; gives the folder of the output (and checkpoint) in the shared folder."""
    base = scratch(stream.sparkSession, label)
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/checkpoint")
    writer = writer.foreachBatch(each) if each else writer.format("parquet").option("path", f"{base}/out")
    query = writer.start()
    query.awaitTermination()
    return f"{base}/out"


def deduplicated(rows: DataFrame, key: str, time: str, horizon: str = "30 days") -> DataFrame:
    """Each key once within the horizon, for a feed without end; state is dropped as the watermark passes, and so are rows behind it.

    A stored table, whose files come in any order, is deduplicated whole by
    ``distinct_batches``.
    """
    timed = rows.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", horizon)
    return timed.dropDuplicatesWithinWatermark([key]).drop("_t")


def batch_parts(rows: DataFrame, label: str, part: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``part`` makes of each micro-batch, all of them together: each is written under its batch number (a replay writes the same place again)."""
    base = scratch(rows.sparkSession, label)
    run_to_end(rows, label, each=lambda batch, n: part(batch).write.mode("overwrite").parquet(f"{base}/batch={n}"))
    return rows.sparkSession.read.parquet(base).drop("batch")


def distinct_batches(keys: DataFrame, label: str = "dedup") -> DataFrame:
    """The distinct rows of a whole table, in whatever order its files come: those of each micro-batch, merged at the end."""
    return batch_parts(keys, label, lambda batch: batch.distinct()).distinct()


def metric_batches(log: DataFrame, label: str = "metrics") -> DataFrame:
    """``metric_buckets`` of a whole log, in whatever order its files come: sums of each micro-batch, added up at the end."""
    return batch_parts(log, label, A.metric_buckets).groupBy("name", "bucket").agg(F.sum("value").alias("value"))


def windowed_metrics(log: DataFrame, *, width: str = "10 minutes", late: str = "2 hours") -> DataFrame:
    """Sum of increments by name and tumbling window of event time, for a feed without end.

    Rows later than ``late`` are dropped and the newest windows stay open; a
    stored log is summed whole by ``metric_batches``.
    """
    timed = log.where("name is not null and n > 0").withColumn("t", F.timestamp_seconds("ts")).withWatermark("t", late)
    return timed.groupBy("name", F.window("t", width)).agg(F.sum("n").alias("value")).select("name", F.unix_seconds(F.col("window.start")).alias("bucket"), "value")


def rollup_batches(rows: DataFrame, label: str = "rollup") -> DataFrame:
    """State of the ids from a stream of sightings.

    Every micro-batch writes its own rollup under its batch number (a replay
    writes the same place again); the state is the merge of all of them.
    """
    spark = rows.sparkSession
    base = scratch(spark, label)

    def write(batch: DataFrame, number: int) -> None:
        P.rollup(P.sightings(batch)).write.mode("overwrite").parquet(f"{base}/batch={number}")

    run_to_end(rows, label, each=write)
    parts = spark.read.parquet(base).drop("batch")
    return P.merged(parts, parts.limit(0))


def correlated(requests: DataFrame, responses: DataFrame, seconds: int = 30) -> DataFrame:
    """Responses (txid, received) joined to the requests (txid, sent) they answer within ``seconds``."""
    a = requests.withWatermark("sent", f"{seconds} seconds").alias("a")
    b = responses.withWatermark("received", f"{seconds} seconds").alias("b")
    close = F.expr(f"a.txid = b.txid AND b.received >= a.sent AND b.received <= a.sent + interval {seconds} seconds")
    return a.join(b, close).select(F.col("a.txid").alias("txid"), "sent", "received")


def fifo_deduplicated(rows: DataFrame, *, key: str, order: str, capacity: int, shards: int) -> DataFrame:
    """``shard, key, order, is_new``: first in first out membership of the last ``capacity`` keys in each shard.

    The state of a shard is its queue of keys and survives between batches.
    """

    def step(shard: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen = P.RecentKeys(capacity)
        seen.keys.update(dict.fromkeys(state.get[0] if state.exists else []))
        rows = pd.concat(list(batches)).sort_values("o", kind="stable")
        flags = [seen.new(k) for k in rows["k"]]
        state.update((list(seen.keys),))
        yield pd.DataFrame({"shard": shard[0], "k": rows["k"], "o": rows["o"], "is_new": flags})

    fed = rows.select(F.col(key).alias("k"), F.col(order).cast("bigint").alias("o")).withColumn("shard", F.pmod(F.xxhash64("k"), F.lit(shards)))
    return fed.groupBy("shard").applyInPandasWithState(step, "shard bigint, k string, o bigint, is_new boolean", "held array<string>", "append", "NoTimeout")


def guarded(write: Callable[[DataFrame, int], None], paused: Callable[[], bool]) -> Callable[[DataFrame, int], None]:
    """A batch writer that does nothing while growth is paused."""

    def run(batch: DataFrame, number: int) -> None:
        if not paused():
            write(batch, number)

    return run


def synced(changes: DataFrame, label: str = "sync") -> DataFrame:
    """Records from a change feed: each batch is written under its number, the newest version of an id wins."""
    spark = changes.sparkSession
    base = scratch(spark, label)
    run_to_end(changes, label, each=lambda batch, n: batch.write.mode("overwrite").parquet(f"{base}/batch={n}"))
    rows = spark.read.parquet(base)
    return rows.groupBy("id").agg(F.max_by(F.struct("name", "total_size", "files", "first_seen", "last_seen", "seen_count", "seq"), "seq").alias("r")).select("id", "r.*")


def packet_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded messages from a folder to which packet files (``packet`` binary, ``received`` bigint) are added."""
    raw = spark.readStream.schema("packet binary, received bigint").parquet(folder)
    return raw.select("received", B.decoded_message(F.col("packet")).alias("m")).where("m.kind is not null").select("received", "m.*")


def sampled_ids(messages: DataFrame) -> DataFrame:
    """Sightings that responses carry: one row for each sampled id."""
    return messages.where("kind = 'response'").select(F.explode("samples").alias("infohash"), F.lit("sample").alias("source"), F.col("received").alias("seen_at"))

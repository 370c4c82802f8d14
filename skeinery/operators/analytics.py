"""Dashboards, time series, health figures, histograms and rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKET = 600  # seconds of a metric bucket
RETENTION = 30 * 86_400


def bucket_start(t: Column, width: int) -> Column:
    """Start of the bucket of a time in seconds."""
    return t - F.pmod(t, F.lit(width).cast("bigint"))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b)


def overview(items: DataFrame) -> DataFrame:
    """One row of totals over the fetched items, and the number of all known ids."""
    got = F.col("fetched")
    peers = F.col("peer_count")
    return items.agg(
        F.count_if(got).alias("torrents"),
        F.coalesce(F.sum(F.when(got, F.col("total_size"))), F.lit(0)).alias("total_size"),
        F.coalesce(F.sum(F.when(got, F.col("file_count"))), F.lit(0)).alias("files"),
        F.coalesce(F.sum(F.when(got & (peers > 0), peers)), F.lit(0)).alias("peers"),
        F.count_if(got & (peers > 0)).alias("alive"),
        F.count_if(got & (peers == 0)).alias("dead"),
        F.count_if(got & F.col("last_check").isNull()).alias("unchecked"),
        F.count("*").alias("known"),
    )


def category_breakdown(items: DataFrame) -> DataFrame:
    """Items and bytes by category with their share of all and the bar width against the largest."""
    per = items.where("fetched").groupBy("category").agg(F.count("*").alias("n"), F.sum("total_size").alias("bytes"))
    every = Window.partitionBy()  # at most eight rows
    return per.select("category", "n", "bytes", F.round(100.0 * F.col("n") / F.sum("n").over(every), 1).alias("share_pct"), (F.col("n") / F.max("n").over(every)).alias("bar"))


def discovery(items: DataFrame, *, now: int, width: int, points: int) -> DataFrame:
    """Fetched items by bucket of first sighting: exactly ``points`` buckets, newest first, empty ones 0."""
    newest = now // width * width
    oldest = newest - (points - 1) * width
    counts = items.where(F.col("fetched") & F.col("first_seen").between(oldest, newest + width - 1)).groupBy(bucket_start(F.col("first_seen"), width).alias("bucket")).agg(F.count("*").alias("n"))
    spine = items.sparkSession.range(oldest, newest + 1, width).withColumnRenamed("id", "bucket")
    return spine.join(F.broadcast(counts), "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.desc("bucket"))


def metric_buckets(log: DataFrame, width: int = BUCKET) -> DataFrame:
    """Sum of the increments by name and bucket; null names and increments that are null or not positive are left out."""
    kept = log.where(F.col("name").isNotNull() & (F.col("n") > 0))
    return kept.groupBy("name", bucket_start(F.col("ts"), width).alias("bucket")).agg(F.sum("n").alias("value"))


def metric_windows(buckets: DataFrame, *, now: int, seconds: int, width: int = BUCKET) -> DataFrame:
    """Events, covered seconds and hourly rate of every name since the bucket in which the window starts."""
    start = (now - seconds) // width * width
    covered = max(now - start, 1)
    per = buckets.groupBy("name").agg(F.coalesce(F.sum(F.when(F.col("bucket") >= start, F.col("value"))), F.lit(0)).alias("events"))
    return per.select("name", "events", F.lit(covered).cast("bigint").alias("covered"), (F.col("events") * 3600.0 / covered).alias("per_hour"))


def retained(buckets: DataFrame, *, now: int, keep: int = RETENTION) -> DataFrame:
    return buckets.where(F.col("bucket") >= now - keep)


#: Pairs whose ratio tells the health of the pipeline.
FUNNEL = [
    ("fetch_success", "fetch_ok", "fetch_attempt"), ("hinted_success", "fetch_ok_hinted", "fetch_ok"), ("triage_dead", "triage_dead", "triage_done"),
    ("duplicates", "dht_duplicates", "dht_harvested"), ("responses", "dht_responses", "dht_queries_sent"), ("rate_limited", "dht_rate_limited", "dht_queries_sent"),
]


def funnel(windows: DataFrame) -> DataFrame:
    """``ratio, part, whole, value`` of the funnel in one pass over the window sums; null without a whole."""
    names = sorted({n for _, a, b in FUNNEL for n in (a, b)})
    sums = windows.agg(*(F.coalesce(F.sum(F.when(F.col("name") == n, F.col("events"))), F.lit(0)).alias(n) for n in names))
    rows = F.array(*(F.struct(F.lit(r).alias("ratio"), F.col(a).alias("part"), F.col(b).alias("whole"), ratio(F.col(a), F.col(b)).alias("value")) for r, a, b in FUNNEL))
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def heartbeat(windows: DataFrame, *, name: str = "engine_alive", period: int = 60) -> DataFrame:
    """Did the engine beat at three quarters of the expected rate?"""
    expected = F.floor(F.max("covered") / period)
    beats = F.coalesce(F.sum(F.when(F.col("name") == name, F.col("events"))), F.lit(0))
    return windows.agg(beats.alias("beats"), expected.alias("expected"), (beats * 4 < expected * 3).alias("unhealthy"))


def probe_histogram(states: DataFrame) -> DataFrame:
    """Probed ids by range of live peers, with their share."""
    p = F.col("probe_peers")
    label = F.when(p == 0, "0").when(p == 1, "1").when(p == 2, "2").when(p <= 4, "3-4").when(p <= 9, "5-9").when(p <= 15, "10-15").otherwise("16+")
    per = states.where(p >= 0).groupBy(label.alias("range")).agg(F.count("*").alias("n"), F.min("probe_peers").alias("low"))
    return per.select("range", "n", "low", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 3).alias("pct"))


def threshold_scenarios(states: DataFrame, thresholds: tuple[int, ...] = (1, 2, 3, 5, 8), per_peer: float = 0.05) -> DataFrame:
    """Ids that reach each threshold of peers and the chance that one of so many peers delivers."""
    counts = states.agg(*(F.count_if(F.col("probe_peers") >= t).alias(f"t{t}") for t in thresholds))
    rows = F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"t{t}").alias("n"), F.lit(1 - (1 - per_peer) ** t).alias("expected")) for t in thresholds))
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def queue_composition(states: DataFrame, *, now: int, hot_window: int = 7200) -> DataFrame:
    """What the backlog consists of, in one pass."""
    pending = F.col("metadata_status") == "pending"
    hot = pending & (F.col("hot_seen") > now - hot_window)
    hinted = pending & ~F.coalesce(hot, F.lit(False)) & (F.col("hint_peers") > 0)
    probed = pending & (F.col("probe_at") > 0)
    total = F.count_if(pending)
    return states.agg(
        total.alias("pending"),
        F.count_if(hot).alias("hot"),
        F.count_if(hinted).alias("hinted"),
        (total - F.count_if(hot) - F.count_if(hinted)).alias("cold"),
        F.count_if(pending & (F.col("fetch_attempts") > 0)).alias("tried"),
        F.count_if(probed).alias("probed"),
        F.count_if(probed & (F.col("probe_peers") > 0)).alias("healthy"),
        F.count_if(probed & (F.col("probe_peers") == 0)).alias("zero"),
        F.min(F.when(probed, F.col("probe_at"))).alias("oldest_probe"),
    )


def status_counts(states: DataFrame) -> DataFrame:
    return states.groupBy(F.coalesce("metadata_status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))


def path_rollup(files: DataFrame) -> DataFrame:
    """Bytes and files under every folder of every record; a folder is a proper prefix of a path."""
    parts = F.split("path", "/")
    depths = F.sequence(F.lit(1), F.size(parts) - 1)
    folders = files.where(F.contains("path", F.lit("/"))).select("id", "size", parts.alias("p"), F.explode(depths).alias("d"))
    folder = F.array_join(F.slice("p", 1, F.col("d")), "/")
    return folders.groupBy("id", folder.alias("folder")).agg(F.sum("size").alias("bytes"), F.count("*").alias("files"))


def counter_deltas(snapshots: DataFrame, *, key: str, order: str, value: str) -> DataFrame:
    """Growth of a counter between snapshots; the first one counts from 0."""
    w = Window.partitionBy(key).orderBy(order)
    return snapshots.select(key, order, (F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0))).alias("delta"))


def smoothed(series: DataFrame, *, key: str, order: str, value: str, keep: float = 0.7) -> DataFrame:
    """Exponential moving average after the last row of each key, as a fold over its ordered values.

    The values of one key form an array: meant for gauges and rates (points of
    a chart), not for raw events.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v"))))
    fold = F.aggregate("a", F.lit(None).cast("double"), lambda acc, x: F.when(acc.isNull(), x["v"]).otherwise(acc * keep + x["v"] * (1 - keep)))
    return series.groupBy(key).agg(ordered.alias("a")).select(key, fold.alias("average"))


def merged_counters(snapshots: DataFrame, counters: list[str]) -> DataFrame:
    """Sum of each counter over instances."""
    return snapshots.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters))


def fetch_snapshot(attempts: DataFrame) -> DataFrame:
    """Mean milliseconds (whole) and mean peers of attempts (``ms``, ``peers``); 0 without attempts."""
    n = F.count("*")
    return attempts.agg(n.alias("attempts"), F.when(n > 0, F.expr("sum(ms) div count(*)")).otherwise(0).alias("avg_ms"), F.when(n > 0, F.sum("peers") / n).otherwise(0.0).alias("avg_peers"))


def outcome_summary(attempts: DataFrame, *, outcome: str = "outcome", ms: str = "ms", ok: str = "ok") -> DataFrame:
    """Attempts by class, success share and the upper median latency of successes."""
    good = F.col(outcome) == ok
    values = attempts.where(good & F.col(ms).isNotNull()).groupBy(F.col(ms).alias("ms")).agg(F.count("*").alias("n"))
    sums = attempts.agg(F.count("*").alias("n"), F.count_if(good).alias("ok"), F.count_if(F.col(outcome) == "timeout").alias("timeout"), F.count_if(~good & (F.col(outcome) != "timeout")).alias("other"), ratio(F.count_if(good), F.count("*")).alias("success"))
    # a row for each distinct latency; whole milliseconds of a fetch that times out are few
    upto = values.withColumn("upto", F.sum("n").over(Window.partitionBy().orderBy("ms").rowsBetween(Window.unboundedPreceding, 0))).select("ms", "upto")
    found = F.broadcast(sums.select(F.expr("ok div 2 + 1").alias("place")))
    median = upto.join(found, F.col("upto") >= F.col("place")).agg(F.min("ms").alias("median_ms"))
    one = F.lit(1).alias("one")
    return sums.select("*", one).join(median.select("*", one), "one").drop("one")


def contingency(attempts: DataFrame, *, transport: str = "transport", outcome: str = "outcome") -> DataFrame:
    """Outcome classes by transport."""
    kind = F.when(F.col(outcome).isin("ok", "timeout"), F.col(outcome)).otherwise("other")
    return attempts.groupBy(transport).agg(*(F.count_if(kind == k).alias(k) for k in ("ok", "timeout", "other")))


def probe_summary(probes: DataFrame, *, key: str = "host", ms: str = "ms") -> DataFrame:
    """Best time, jitter and loss of repeated probes; a null time is a loss."""
    return probes.groupBy(key).agg(F.min(ms).alias("best"), (F.max(ms) - F.min(ms)).alias("jitter"), F.expr(f"count_if({ms} is null) * 100 div count(*)").alias("loss_pct"))


def order_experiment(states: DataFrame, orders: dict[str, list[Column]], limit: int = 40) -> DataFrame:
    """For several orders of candidates: mean live peers and share without any among the first ``limit``."""
    out = None
    for label, order in orders.items():
        first = states.orderBy(*order).limit(limit).agg(F.avg(F.greatest("probe_peers", F.lit(0))).alias("mean_peers"), F.avg((F.col("probe_peers") <= 0).cast("double")).alias("share_zero")).select(F.lit(label).alias("label"), "mean_peers", "share_zero")
        out = first if out is None else out.unionByName(first)
    return out


def evaluation(results: DataFrame, expected: DataFrame, *, at: int = 5) -> DataFrame:
    """hit@k, mean reciprocal rank and the share of empty queries that stayed empty.

    ``results``: query, rank (from 1), name; ``expected``: query, wanted (array
    of substrings, empty: nothing may be found).
    """
    joined = expected.join(results, "query", "left")
    hit = F.exists("wanted", lambda w: F.contains(F.lower("name"), F.lower(w)))
    per = joined.groupBy("query").agg(F.min(F.when(hit, F.col("rank"))).alias("first"), F.count("name").alias("n"), F.max(F.size("wanted")).alias("wanted"))
    real = F.col("wanted") > 0
    return per.agg(
        F.count_if(real).alias("queries"),
        F.avg(F.when(real, (F.coalesce("first", F.lit(1 << 30)) <= at).cast("double"))).alias("hit_rate"),
        F.avg(F.when(real, F.coalesce(1.0 / F.col("first"), F.lit(0.0)))).alias("mrr"),
        F.avg(F.when(~real, (F.col("n") == 0).cast("double"))).alias("empty_ok"),
    )


def nth_slices(rows: DataFrame, *, order: list[Column], slices: int) -> DataFrame:
    """Every n-th row of an order gets the same slice number; for short lists such as a page, as one task numbers them."""
    return rows.withColumn("slice", F.pmod(F.row_number().over(Window.partitionBy().orderBy(*order)) - 1, F.lit(slices)))


def embedding_counts(embeddings: DataFrame) -> DataFrame:
    return embeddings.groupBy("model_id").agg(F.countDistinct("id").alias("ids"), F.count("*").alias("vectors"))


def noise_floor(scores: DataFrame, least: float) -> DataFrame:
    """Median of the best scores of meaningless queries, not below ``least``."""
    best = scores.groupBy("query").agg(F.max("score").alias("best"))
    return best.agg(F.greatest(F.percentile("best", 0.5), F.lit(least)).alias("floor"))




def heartbeat_rows(spark: SparkSession, since: int, until: int, every: int = 60) -> DataFrame:
    """The increments (name, ts, n) a live engine logs: one a tick from ``since`` up to ``until``, exclusive."""
    return spark.range(since, until, every).select(F.lit("engine_alive").alias("name"), F.col("id").alias("ts"), F.lit(1).cast("bigint").alias("n"))

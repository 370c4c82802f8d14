"""Dashboards, series and health queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skeinery.operators import analytics as A
from skeinery.operators import catalog as C
from skeinery.operators import vector_search as VS
from skeinery.plans import oracle as O
from skeinery.plans import stores
from skeinery.sources.tables import table

NOW = O.NOW
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _add(name: str, query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


_add("overview", lambda s, d: A.overview(stores.items(s, d)), f"""WITH {O.ITEMS} SELECT count(*) FILTER (fetched) AS torrents, coalesce(sum(total_size) FILTER (fetched), 0)::BIGINT AS total_size, coalesce(sum(file_count) FILTER (fetched), 0)::BIGINT AS files,
 coalesce(sum(peer_count) FILTER (fetched AND peer_count > 0), 0)::BIGINT AS peers, count(*) FILTER (fetched AND peer_count > 0) AS alive, count(*) FILTER (fetched AND peer_count = 0) AS dead,
 count(*) FILTER (fetched AND last_check IS NULL) AS unchecked, count(*) AS known FROM items""")
_add("category_breakdown", lambda s, d: A.category_breakdown(stores.items(s, d)), f"""WITH {O.ITEMS}, c AS (SELECT category, count(*) AS n, sum(total_size)::BIGINT AS bytes FROM items WHERE fetched GROUP BY category)
SELECT category, n, bytes, round(100.0::DOUBLE * n / sum(n) OVER (), 1) AS share_pct, n::DOUBLE / max(n) OVER () AS bar FROM c""")
for _name, _width, _points in (("discovery_hourly", 3600, 48), ("discovery_daily", 86_400, 365)):
    _add(_name, lambda s, d, w=_width, p=_points: A.discovery(stores.items(s, d), now=NOW, width=w, points=p), f"""WITH {O.ITEMS}, spine AS (SELECT unnest(range({NOW // _width * _width - (_points - 1) * _width}, {NOW // _width * _width + 1}, {_width})) AS bucket),
c AS (SELECT first_seen // {_width} * {_width} AS bucket, count(*) AS n FROM items WHERE fetched GROUP BY 1) SELECT spine.bucket, coalesce(n, 0) AS n FROM spine LEFT JOIN c USING (bucket)""")

_LOG = "b AS (SELECT name, (ts - ((ts % 600) + 600) % 600) AS bucket, sum(n)::BIGINT AS value FROM metric_log WHERE name IS NOT NULL AND n > 0 GROUP BY 1, 2)"
_DAY = 86_400


def _buckets(s, d):
    return A.metric_buckets(table(s, d, "metric_log"))


_add("metric_buckets", _buckets, f"WITH {_LOG} SELECT name, bucket, value FROM b")
_start = (NOW - 30 * _DAY) // 600 * 600
_WINDOW = f"{_LOG}, w AS (SELECT name, coalesce(sum(value) FILTER (bucket >= {_start}), 0)::BIGINT AS events, {NOW - _start}::BIGINT AS covered FROM b GROUP BY name)"


def _window(s, d):
    return A.metric_windows(_buckets(s, d), now=NOW, seconds=30 * _DAY)


_add("metric_window", _window, f"WITH {_WINDOW} SELECT name, events, covered, events * 3600.0::DOUBLE / covered AS per_hour FROM w")
_add("metric_retention", lambda s, d: A.retained(_buckets(s, d), now=NOW), f"WITH {_LOG} SELECT name, bucket, value FROM b WHERE bucket >= {NOW - A.RETENTION}")
_add("funnel_rates", lambda s, d: A.funnel(_window(s, d)), f"WITH {_WINDOW} SELECT ratio, part, whole, CASE WHEN whole > 0 THEN part::DOUBLE / whole END AS value FROM (" + " UNION ALL ".join(
    f"SELECT '{r}' AS ratio, coalesce(sum(events) FILTER (name = '{a}'), 0)::BIGINT AS part, coalesce(sum(events) FILTER (name = '{b}'), 0)::BIGINT AS whole FROM w" for r, a, b in A.FUNNEL) + ")")
_add("heartbeat_ticks", lambda s, d: A.metric_buckets(A.heartbeat_rows(s, NOW - _DAY, NOW)), f"SELECT 'engine_alive' AS name, t - t % 600 AS bucket, count(*) AS value FROM (SELECT unnest(range({NOW - _DAY}, {NOW}, 60)) AS t) GROUP BY 2")
_add("heartbeat", lambda s, d: A.heartbeat(_window(s, d)), f"WITH {_WINDOW} SELECT beats, expected, beats * 4 < expected * 3 AS unhealthy FROM (SELECT coalesce(sum(events) FILTER (name = 'engine_alive'), 0)::BIGINT AS beats, (max(covered) // 60)::BIGINT AS expected FROM w)")

_RANGE = "CASE WHEN probe_peers = 0 THEN '0' WHEN probe_peers = 1 THEN '1' WHEN probe_peers = 2 THEN '2' WHEN probe_peers <= 4 THEN '3-4' WHEN probe_peers <= 9 THEN '5-9' WHEN probe_peers <= 15 THEN '10-15' ELSE '16+' END"
_add("probe_histogram", lambda s, d: A.probe_histogram(C.states(s, d)), f"""WITH {O.STATES}, h AS (SELECT {_RANGE} AS range, count(*) AS n, min(probe_peers) AS low FROM st WHERE probe_peers >= 0 GROUP BY 1)
SELECT range, n, low, round(100.0::DOUBLE * n / sum(n) OVER (), 3) AS pct FROM h""")
_add("threshold_scenarios", lambda s, d: A.threshold_scenarios(C.states(s, d)).withColumn("expected", F.round("expected", 9)), f"WITH {O.STATES} " + " UNION ALL ".join(
    f"SELECT {t} AS threshold, count(*) FILTER (probe_peers >= {t}) AS n, round(1 - pow(0.95::DOUBLE, {t}), 9) AS expected FROM st" for t in (1, 2, 3, 5, 8)))
_add("queue_stats", lambda s, d: A.queue_composition(C.states(s, d), now=NOW), f"""WITH {O.STATES}, p AS (SELECT *, coalesce(hot_seen > {NOW - 7200}, false) AS hot FROM st WHERE metadata_status = 'pending')
SELECT count(*) AS pending, count(*) FILTER (hot) AS hot, count(*) FILTER (NOT hot AND hint_peers > 0) AS hinted, count(*) - count(*) FILTER (hot) - count(*) FILTER (NOT hot AND hint_peers > 0) AS cold,
 count(*) FILTER (fetch_attempts > 0) AS tried, count(*) FILTER (probe_at > 0) AS probed, count(*) FILTER (probe_at > 0 AND probe_peers > 0) AS healthy, count(*) FILTER (probe_at > 0 AND probe_peers = 0) AS zero,
 min(probe_at) FILTER (probe_at > 0) AS oldest_probe FROM p""")
_add("status_counts", lambda s, d: A.status_counts(C.states(s, d)), f"WITH {O.STATES} SELECT coalesce(metadata_status, 'unknown') AS status, count(*) AS n FROM st GROUP BY 1")
_add("path_rollup", lambda s, d: A.path_rollup(C.files(s, d)), f"""WITH {O.RECORDS}, {O.FILES}, f AS (SELECT id, size, string_split(path, '/') AS p FROM child WHERE contains(path, '/')),
x AS (SELECT id, size, p, unnest(range(1, len(p))) AS d FROM f) SELECT id, array_to_string(p[1:d], '/') AS folder, sum(size)::BIGINT AS bytes, count(*) AS files FROM x GROUP BY 1, 2""")

_SNAP = f"{_LOG}, c AS (SELECT name, bucket, sum(value) OVER (PARTITION BY name ORDER BY bucket)::BIGINT AS total FROM b)"


def _snapshots(s, d):
    """Running totals of the metric log, as an instance would report them."""
    return _buckets(s, d).withColumn("total", F.sum("value").over(Window.partitionBy("name").orderBy("bucket")))


_add("counter_deltas", lambda s, d: A.counter_deltas(_snapshots(s, d), key="name", order="bucket", value="total"), f"WITH {_SNAP} SELECT name, bucket, total - coalesce(lag(total) OVER (PARTITION BY name ORDER BY bucket), 0) AS delta FROM c")
_add("counter_merge", lambda s, d: A.merged_counters(_buckets(s, d).groupBy("name").pivot("name", ["sighting", "fetch_ok"]).agg(F.sum("value")), ["sighting", "fetch_ok"]), f"WITH {_LOG} SELECT coalesce(sum(value) FILTER (name = 'sighting'), 0)::BIGINT AS sighting, coalesce(sum(value) FILTER (name = 'fetch_ok'), 0)::BIGINT AS fetch_ok FROM b")
_add("smoothed_rate", lambda s, d: A.smoothed(_buckets(s, d), key="name", order="bucket", value="value"), f"WITH {_LOG} SELECT name, list_reduce(list(value::DOUBLE ORDER BY bucket NULLS FIRST), lambda a, x: a * 0.7::DOUBLE + x * (1 - 0.7::DOUBLE)) AS average FROM b GROUP BY name")
_add("share_of_total", lambda s, d: table(s, d, "sightings").groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.count("*").alias("n")).withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 3)),
     "SELECT source, n, round(100.0::DOUBLE * n / sum(n) OVER (), 3) AS pct FROM (SELECT coalesce(source, 'none') AS source, count(*) AS n FROM sightings GROUP BY 1)")
_add("embedding_counts", lambda s, d: A.embedding_counts(table(s, d, "torrent_embeddings")), "SELECT model_id, count(DISTINCT id) AS ids, count(*) AS vectors FROM torrent_embeddings GROUP BY model_id")
_add("index_memory", lambda s, d: VS.index_memory(table(s, d, "torrent_embeddings")), "SELECT dim, count(*) AS n, sum(dim + 56)::BIGINT AS bytes FROM torrent_embeddings GROUP BY dim")

_ORDERS = {"by_peers": ["probe_peers"], "by_probe_time": ["probe_at"], "by_last_seen": ["last_seen"], "by_count": ["seen_count"]}
_add("order_experiment", lambda s, d: A.order_experiment(C.states(s, d), {k: [F.desc(c) for c in v] + [F.asc("id")] for k, v in _ORDERS.items()}), f"WITH {O.STATES} " + " UNION ALL ".join(
    f"SELECT '{k}' AS label, avg(greatest(probe_peers, 0)) AS mean_peers, avg((probe_peers <= 0)::INT::DOUBLE) AS share_zero FROM (SELECT * FROM st ORDER BY {v[0]} DESC NULLS LAST, id LIMIT 40)" for k, v in _ORDERS.items()))


def _attempts(s, d):
    """Fetch attempts read off the states: outcome, a duration and the peers at hand."""
    p = F.col("probe_peers")
    outcome = F.when(F.col("metadata_status") == "fetched", "ok").when(p <= 0, "timeout").otherwise("other")
    return C.states(s, d).where("fetch_attempts > 0").select("id", outcome.alias("outcome"), F.greatest(p, F.lit(0)).alias("peers"), F.pmod("last_attempt", F.lit(10_000)).alias("ms"), F.when(F.col("hint_peers") > 0, "hinted").otherwise("plain").alias("transport"), F.when(p > 0, F.pmod("last_attempt", F.lit(997))).alias("rtt"))


_ATT = f"""{O.STATES}, att AS (SELECT id, CASE WHEN metadata_status = 'fetched' THEN 'ok' WHEN probe_peers <= 0 THEN 'timeout' ELSE 'other' END AS outcome, greatest(probe_peers, 0) AS peers,
 last_attempt % 10000 AS ms, CASE WHEN hint_peers > 0 THEN 'hinted' ELSE 'plain' END AS transport, CASE WHEN probe_peers > 0 THEN last_attempt % 997 END AS rtt FROM st WHERE fetch_attempts > 0)"""
_add("fetch_snapshot", lambda s, d: A.fetch_snapshot(_attempts(s, d)), f"WITH {_ATT} SELECT count(*) AS attempts, (sum(ms) // count(*))::BIGINT AS avg_ms, sum(peers)::DOUBLE / count(*) AS avg_peers FROM att")
_add("fetch_outcomes", lambda s, d: A.outcome_summary(_attempts(s, d)), f"""WITH {_ATT} SELECT count(*) AS n, count(*) FILTER (outcome = 'ok') AS ok, count(*) FILTER (outcome = 'timeout') AS timeout, count(*) FILTER (outcome = 'other') AS other,
 count(*) FILTER (outcome = 'ok')::DOUBLE / count(*) AS success, list_sort(list(ms) FILTER (outcome = 'ok'))[count(*) FILTER (outcome = 'ok') // 2 + 1] AS median_ms FROM att""")
_add("transport_contingency", lambda s, d: A.contingency(_attempts(s, d)), f"WITH {_ATT} SELECT transport, count(*) FILTER (outcome = 'ok') AS ok, count(*) FILTER (outcome = 'timeout') AS timeout, count(*) FILTER (outcome NOT IN ('ok', 'timeout')) AS other FROM att GROUP BY 1")
_add("probe_summary", lambda s, d: A.probe_summary(_attempts(s, d), key="transport", ms="rtt"), f"WITH {_ATT} SELECT transport, min(rtt) AS best, max(rtt) - min(rtt) AS jitter, (count(*) FILTER (rtt IS NULL) * 100 // count(*))::BIGINT AS loss_pct FROM att GROUP BY 1")
_add("nth_slices", lambda s, d: A.nth_slices(C.top_by(stores.items(s, d), "seen", 500).select("id", "seen_count"), order=[F.desc("seen_count"), F.asc("id")], slices=4), f"""WITH {O.ITEMS}, t AS (SELECT id, seen_count FROM items WHERE fetched ORDER BY seen_count DESC, id LIMIT 500)
SELECT id, seen_count, (row_number() OVER (ORDER BY seen_count DESC, id) - 1) % 4 AS slice FROM t""")

"""Queries of the event pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinery.operators import catalog as C
from skeinery.operators import pipeline as P
from skeinery.plans import oracle as O
from skeinery.plans import stores
from skeinery.sources.tables import table

NOW = O.NOW
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


def _seen(s, d):
    return P.sightings(table(s, d, "sightings"))


_ROLL = "SELECT id, min(seen_at) AS first_seen, max(seen_at) AS last_seen, sum(weight)::BIGINT AS seen_count, max(seen_at) FILTER (hot) AS hot_seen, count(*) FILTER (hot) AS hot_count, max(n_peers)::BIGINT AS hint_peers FROM seen GROUP BY id"
_add("sighting_rollup", lambda s, d: P.rollup(_seen(s, d)), f"WITH {O.SEEN} {_ROLL}")


def sighting_upsert(s, d):
    """The rollup of two batches merged equals the rollup of both."""
    seen = _seen(s, d)
    return P.merged(P.rollup(seen.where("sighting_id % 2 = 0")), P.rollup(seen.where("sighting_id % 2 = 1")))


_add("sighting_upsert", sighting_upsert, f"WITH {O.SEEN} {_ROLL}")
_add("duplicate_tally", lambda s, d: P.duplicate_tally(_seen(s, d), 3600), f"WITH {O.SEEN} SELECT id, seen_at // 3600 * 3600 AS period, count(*) - 1 AS repeats FROM seen WHERE NOT hot AND n_peers = 0 GROUP BY 1, 2 HAVING count(*) > 1")
_add("admission", lambda s, d: P.admitted(_seen(s, d), P.MAX_BACKLOG + 1).select("sighting_id"), f"WITH {O.SEEN} SELECT sighting_id FROM seen WHERE hot OR n_peers > 0")
_add("record_upsert", lambda s, d: P.upserted_records(C.records(s, d).drop("_v"), C.records(s, d).where("seen_count > 2").withColumn("name", F.concat("name", F.lit(" v2"))).withColumn("seen_count", F.lit(1).cast("bigint"))).select("id", "name", "first_seen", "last_seen", "seen_count"), f"WITH {O.RECORDS} SELECT id, CASE WHEN seen_count > 2 THEN name || ' v2' ELSE name END AS name, first_seen, last_seen, seen_count + (seen_count > 2)::INT AS seen_count FROM recs")
_add("latest_liveness", lambda s, d: P.latest_liveness(table(s, d, "torrent_state").where("probe_at > 0").groupBy("id", F.col("probe_at").alias("ts")).agg(F.max("probe_peers").alias("peers"))), "WITH o AS (SELECT id, probe_at AS ts, max(probe_peers) AS peers FROM torrent_state WHERE probe_at > 0 GROUP BY 1, 2) SELECT id, greatest(arg_max(peers, ts), 0) AS peer_count, max(ts) AS last_check FROM o GROUP BY id")
_add("triage_queue", lambda s, d: P.triage_queue(C.states(s, d), 100).select("id", "last_seen"), f"WITH {O.STATES} SELECT id, last_seen FROM st WHERE metadata_status = 'pending' AND probe_at = 0 ORDER BY last_seen DESC, id LIMIT 100")

_ELIGIBLE = f"(fetch_attempts = 0 OR (fetch_attempts < 3 AND last_attempt < {NOW - P.RETRY}))"
_add("fetch_live", lambda s, d: P.live_arm(C.states(s, d), NOW, 100).select("id", "probe_peers", "hint_peers"), f"""WITH {O.STATES} SELECT id, probe_peers, hint_peers FROM st WHERE metadata_status = 'pending' AND {_ELIGIBLE}
 AND (probe_at > {NOW - P.FRESH_PROBE} OR hot_seen > {NOW - P.HOT_WINDOW} OR hint_peers >= 1) AND (probe_peers >= 1 OR (probe_peers < 0 AND (hint_peers >= 1 OR hot_seen > {NOW - P.HOT_WINDOW}))) ORDER BY probe_peers DESC, hint_peers DESC, seen_count DESC, id LIMIT 100""")
_HOT_ARM = f"hot AS (SELECT id, row_number() OVER (ORDER BY hot_seen DESC, id) AS pos FROM st WHERE metadata_status = 'pending' AND {_ELIGIBLE} AND hot_seen > {NOW - P.HOT_WINDOW} QUALIFY pos <= 20)"
_LIVE_ARM = f"""live AS (SELECT id, row_number() OVER (ORDER BY probe_peers DESC, hint_peers DESC, seen_count DESC, id) AS pos FROM st WHERE metadata_status = 'pending' AND {_ELIGIBLE}
 AND (probe_at > {NOW - P.FRESH_PROBE} OR hot_seen > {NOW - P.HOT_WINDOW} OR hint_peers >= 1) AND (probe_peers >= 1 OR (probe_peers < 0 AND (hint_peers >= 1 OR hot_seen > {NOW - P.HOT_WINDOW}))) QUALIFY pos <= 40)"""
_QUEUE = f"{O.STATES}, {_HOT_ARM}, {_LIVE_ARM}, b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY arm, pos) AS n FROM (SELECT id, 0 AS arm, pos FROM hot UNION ALL SELECT id, 1, pos FROM live)), queue AS (SELECT id, arm, pos, row_number() OVER (ORDER BY arm, pos) AS place FROM b WHERE n = 1 QUALIFY place <= 40)"
_add("fetch_queue", lambda s, d: P.fetch_queue(C.states(s, d), NOW, 40), f"WITH {_QUEUE} SELECT id, arm, pos, place FROM queue")
_add("fetch_marked", lambda s, d: P.marked_tried(C.states(s, d), P.fetch_queue(C.states(s, d), NOW, 40), NOW).select("id", "fetch_attempts", "last_attempt"), f"WITH {_QUEUE} SELECT st.id, fetch_attempts + (q.id IS NOT NULL)::INT AS fetch_attempts, CASE WHEN q.id IS NOT NULL THEN {NOW} ELSE last_attempt END AS last_attempt FROM st LEFT JOIN queue q ON st.id = q.id")
_add("purge", lambda s, d: P.purge(C.states(s, d), NOW).groupBy("action").agg(F.count("*").alias("n")), f"""WITH {O.STATES} SELECT CASE WHEN metadata_status = 'pending' AND probe_peers = 0 AND last_seen < {NOW - 3 * 86_400} THEN 'dead' WHEN metadata_status = 'unreachable' AND last_seen < {NOW - 3 * 86_400} THEN 'unreachable'
 WHEN metadata_status = 'pending' AND probe_peers < 0 AND probe_at > 0 AND probe_at < {NOW - P.STALE_PROBE} THEN 'reset'
 WHEN metadata_status = 'pending' AND fetch_attempts > 0 AND probe_at > 0 AND probe_at < {NOW - P.FRESH_PROBE} AND (hot_seen IS NULL OR hot_seen < {NOW - P.FRESH_PROBE}) THEN 'tried' ELSE 'keep' END AS action, count(*) AS n FROM st GROUP BY 1""")
_add("peer_hints", lambda s, d: P.latest_hints(table(s, d, "sightings").dropDuplicates(["sighting_id"])), """WITH u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sighting_id ORDER BY arrived_at) AS n FROM sightings) WHERE n = 1)
SELECT lower(infohash) AS id, list_slice(arg_max(peers, sighting_id), 1, 16) AS peers FROM u WHERE regexp_full_match(infohash, '[0-9a-fA-F]{40}') AND len(peers) > 0 GROUP BY 1""")
_add("first_wins_union", lambda s, d: P.first_wins([C.states(s, d).where("probe_peers > 5").orderBy(F.desc("probe_peers"), "id").limit(50), C.states(s, d).orderBy(F.desc("seen_count"), "id").limit(50)], [[F.desc("probe_peers"), F.asc("id")], [F.desc("seen_count"), F.asc("id")]]), f"""WITH {O.STATES}, a AS (SELECT id, 0 AS arm, row_number() OVER (ORDER BY probe_peers DESC, id) AS pos FROM st WHERE probe_peers > 5 QUALIFY pos <= 50), b AS (SELECT id, 1 AS arm, row_number() OVER (ORDER BY seen_count DESC NULLS LAST, id) AS pos FROM st QUALIFY pos <= 50)
SELECT id, arm, pos FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY arm, pos) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) WHERE n = 1""")
_add("garbled_arm", lambda s, d: P.garbled_arm(stores.items(s, d), 20).select("id", "name"), f"WITH {O.ITEMS} SELECT id, name FROM items WHERE fetched AND garbled ORDER BY seen_count DESC, id LIMIT 20")
_add("alive_sample", lambda s, d: P.alive_sample(C.states(s, d), 50).select("id", "probe_peers"), f"WITH {O.STATES} SELECT id, probe_peers FROM st WHERE probe_peers > 0 ORDER BY probe_peers DESC, id LIMIT 50")
_add("ready_stock", lambda s, d: P.ready_stock(C.states(s, d), NOW), f"""WITH {O.STATES} SELECT count(*) FILTER (metadata_status = 'pending' AND probe_peers >= 1 AND fetch_attempts = 0) AS never_tried,
 count(*) FILTER (metadata_status = 'pending' AND probe_peers >= 1 AND fetch_attempts > 0 AND {_ELIGIBLE}) AS retryable, count(*) FILTER (metadata_status = 'pending' AND probe_at > 0 AND probe_peers < 0) AS leaked FROM st""")


def recategorized(s, d):
    """Items whose category was forgotten get it back."""
    forgotten = stores.items(s, d).withColumn("category", F.when(F.col("seen_count") % 2 == 0, "other").otherwise(F.col("category")))
    return P.recategorized(forgotten).select("id", "category")


_add("recategorized", recategorized, f"WITH {O.ITEMS} SELECT id, category FROM items WHERE seen_count % 2 = 0 AND category <> 'other'")

_add("newest_nodes", lambda s, d: P.newest_nodes(_seen(s, d), "sighting_id", 1000).select("sighting_id", "id"), f"WITH {O.SEEN} SELECT sighting_id, id FROM seen ORDER BY sighting_id DESC LIMIT 1000")

"""The event pipeline in batch: sightings, duplicates, queues, liveness, purge, bounded caches."""

from __future__ import annotations

from collections import Counter, OrderedDict, deque
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinery.functions import text as T

HOT = ["sample_peers", "get_peers", "announce"]
HOT_WINDOW, FRESH_PROBE, STALE_PROBE, RETRY = 7200, 21_600, 3600, 21_600
MAX_ATTEMPTS, GARBLED_MOST = 3, 2
MAX_BACKLOG = 20_000


def is_hot(source: Column) -> Column:
    """Sightings from passive traffic; a null source is cold."""
    return F.coalesce(source.isin(HOT), F.lit(False))


def weight(repeats: Column) -> Column:
    """A flushed counter counts its repeats, any other sighting 1."""
    return F.greatest(F.coalesce(repeats, F.lit(0)), F.lit(1))


def sightings(rows: DataFrame) -> DataFrame:
    """Each sighting once under its canonical id; values that are no id are left out."""
    kept = rows.where(T.is_id(F.col("infohash")))
    return kept.select("sighting_id", F.lower("infohash").alias("id"), "source", F.coalesce(F.array_size("peers"), F.lit(0)).alias("n_peers"), weight(F.col("repeats")).alias("weight"), "seen_at").dropDuplicates(["sighting_id"])


def rollup(seen: DataFrame) -> DataFrame:
    """State of every id from its sightings: commutative, so late and repeated batches do no harm.

    Times merge by min and max, counts add up; partial aggregation keeps a hot
    id to one row a task.
    """
    hot = is_hot(F.col("source"))
    return seen.groupBy("id").agg(
        F.min("seen_at").alias("first_seen"),
        F.max("seen_at").alias("last_seen"),
        F.sum("weight").alias("seen_count"),
        F.max(F.when(hot, F.col("seen_at"))).alias("hot_seen"),
        F.count_if(hot).alias("hot_count"),
        F.max("n_peers").cast("bigint").alias("hint_peers"),
    )


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two rollups as one: the upsert of a batch into the state."""
    both = old.select(*new.columns).unionByName(new)
    return both.groupBy("id").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("seen_count").alias("seen_count"), F.max("hot_seen").alias("hot_seen"), F.sum("hot_count").alias("hot_count"), F.max("hint_peers").alias("hint_peers"))


def upserted_records(old: DataFrame, new: DataFrame) -> DataFrame:
    """Fetched metadata into records: the newest name and files, earliest first and latest last sighting, counts added."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    newest = F.struct("_v", "last_seen", "name", "total_size", "files")
    return both.groupBy("id").agg(F.max(newest).alias("r"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("seen_count").alias("seen_count")).select("id", "r.name", "r.total_size", "r.files", "first_seen", "last_seen", "seen_count")


def duplicate_tally(seen: DataFrame, seconds: int = 15) -> DataFrame:
    """Suppressed duplicates of cold sightings without peers, by id and flush period."""
    cold = seen.where(~is_hot(F.col("source")) & (F.col("n_peers") == 0))
    per = cold.groupBy("id", F.expr(f"(seen_at div {seconds}) * {seconds}").alias("period")).agg((F.count("*") - 1).alias("repeats"))
    return per.where("repeats > 0")


def admitted(seen: DataFrame, backlog: int, most: int = MAX_BACKLOG) -> DataFrame:
    """While the backlog is too long, cold sightings without peers are turned away."""
    if backlog <= most:
        return seen
    return seen.where(is_hot(F.col("source")) | (F.col("n_peers") > 0))


def triage_queue(states: DataFrame, limit: int) -> DataFrame:
    """Pending ids never probed, most recently seen first."""
    return states.where("metadata_status = 'pending' AND probe_at = 0").orderBy(F.desc("last_seen"), "id").limit(limit)


def eligible(now: int) -> Column:
    """Never tried, or tried fewer than three times and not lately."""
    return (F.col("fetch_attempts") == 0) | ((F.col("fetch_attempts") < MAX_ATTEMPTS) & (F.col("last_attempt") < now - RETRY))


def fresh(now: int) -> Column:
    return (F.col("probe_at") > now - FRESH_PROBE) | (F.col("hot_seen") > now - HOT_WINDOW) | (F.col("hint_peers") >= 1)


def lively(now: int) -> Column:
    """Some sign that peers exist."""
    return (F.col("probe_peers") >= 1) | ((F.col("probe_peers") < 0) & ((F.col("hint_peers") >= 1) | (F.col("hot_seen") > now - HOT_WINDOW)))


def hot_arm(states: DataFrame, now: int, limit: int) -> DataFrame:
    rows = states.where((F.col("metadata_status") == "pending") & eligible(now) & (F.col("hot_seen") > now - HOT_WINDOW))
    return rows.orderBy(F.desc("hot_seen"), "id").limit(limit)


def live_arm(states: DataFrame, now: int, limit: int) -> DataFrame:
    rows = states.where((F.col("metadata_status") == "pending") & eligible(now) & fresh(now) & lively(now))
    return rows.orderBy(F.desc("probe_peers"), F.desc("hint_peers"), F.desc("seen_count"), "id").limit(limit)


def garbled_arm(items: DataFrame, limit: int = GARBLED_MOST) -> DataFrame:
    """Fetched items whose name lost characters, to be fetched again."""
    return items.where("fetched AND garbled").orderBy(F.desc("seen_count"), "id").limit(limit)


def alive_sample(states: DataFrame, limit: int) -> DataFrame:
    return states.where("probe_peers > 0").orderBy(F.desc("probe_peers"), "id").limit(limit)


def ready_stock(states: DataFrame, now: int) -> DataFrame:
    """What could be fetched at once: never tried, to be tried again, and probes whose result never came."""
    pending = F.col("metadata_status") == "pending"
    healthy = pending & (F.col("probe_peers") >= 1)
    return states.agg(
        F.count_if(healthy & (F.col("fetch_attempts") == 0)).alias("never_tried"),
        F.count_if(healthy & (F.col("fetch_attempts") > 0) & eligible(now)).alias("retryable"),
        F.count_if(pending & (F.col("probe_at") > 0) & (F.col("probe_peers") < 0)).alias("leaked"),
    )


def recategorized(items: DataFrame, limit: int | None = None) -> DataFrame:
    """Items of category 'other' with the category their name and files give now, where that differs.

    All of them, or with ``limit`` the first by id: rows that stay 'other'
    don't count, so repeated calls get through to the end.
    """
    rows = items.where("category = 'other'").withColumn("category", T.category(F.col("name"), F.col("files"))).where("category <> 'other'")
    return rows if limit is None else rows.orderBy("id").limit(limit)


def first_wins(arms: list[DataFrame], orders: list[list[Column]]) -> DataFrame:
    """Several short ordered lists as one: arm by arm, an id keeps its first place."""
    out = None
    for n, (arm, order) in enumerate(zip(arms, orders)):
        placed = arm.select("id", F.lit(n).alias("arm"), F.row_number().over(Window.partitionBy().orderBy(*order)).alias("pos"))
        out = placed if out is None else out.unionByName(placed)
    best = Window.partitionBy("id").orderBy("arm", "pos")
    return out.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def fetch_queue(states: DataFrame, now: int, limit: int) -> DataFrame:
    """``id, arm, pos``: half of the places for hot ids, the rest by live peers, first place wins."""
    quota = max(limit // 2, 1)
    hot = hot_arm(states, now, quota)
    live = live_arm(states, now, limit)
    both = first_wins([hot, live], [[F.desc("hot_seen"), F.asc("id")], [F.desc("probe_peers"), F.desc("hint_peers"), F.desc("seen_count"), F.asc("id")]])
    place = Window.partitionBy().orderBy("arm", "pos")
    return both.withColumn("place", F.row_number().over(place)).where(F.col("place") <= max(limit, 1))


def marked_tried(states: DataFrame, chosen: DataFrame, now: int) -> DataFrame:
    """The states after ``chosen`` were handed out."""
    joined = states.join(chosen.select("id", F.lit(True).alias("_c")), "id", "left")
    return joined.withColumns({"fetch_attempts": F.col("fetch_attempts") + F.when(F.col("_c"), 1).otherwise(0), "last_attempt": F.when(F.col("_c"), F.lit(now)).otherwise(F.col("last_attempt"))}).drop("_c")


def latest_liveness(observations: DataFrame) -> DataFrame:
    """``id, peer_count, last_check`` from a log of probes (id, ts, peers)."""
    return observations.groupBy("id").agg(F.greatest(F.max_by("peers", "ts"), F.lit(0)).alias("peer_count"), F.max("ts").alias("last_check"))


def purge(states: DataFrame, now: int, age: int = 3 * 86_400) -> DataFrame:
    """States with ``action``: why a row goes ('dead', 'unreachable', 'tried'), 'reset' for a stale mark, 'keep' otherwise.

    The marks are reset before tried rows are judged, so a reset row stays.
    """
    cut = now - age
    pending = F.col("metadata_status") == "pending"
    stale = pending & (F.col("probe_peers") < 0) & (F.col("probe_at") > 0) & (F.col("probe_at") < now - STALE_PROBE)
    tried = pending & (F.col("fetch_attempts") > 0) & (F.col("probe_at") > 0) & (F.col("probe_at") < now - FRESH_PROBE) & (F.col("hot_seen").isNull() | (F.col("hot_seen") < now - FRESH_PROBE))
    action = (
        F.when(pending & (F.col("probe_peers") == 0) & (F.col("last_seen") < cut), "dead")
        .when((F.col("metadata_status") == "unreachable") & (F.col("last_seen") < cut), "unreachable")
        .when(stale, "reset")
        .when(tried, "tried")
        .otherwise("keep")
    )
    return states.withColumn("action", action)


class RecentKeys:
    """The last ``capacity`` keys by first insertion; an evicted key counts as new again."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.keys: OrderedDict[str, None] = OrderedDict()

    def new(self, key: str) -> bool:
        if key in self.keys:
            return False
        self.keys[key] = None
        if len(self.keys) > self.capacity:
            self.keys.popitem(last=False)
        return True


def fifo_new(keys: Iterable[str], capacity: int) -> list[bool]:
    seen = RecentKeys(capacity)
    return [seen.new(k) for k in keys]


class HintCache:
    """Latest peers of an id, first in first out by first insertion; taking removes."""

    def __init__(self, capacity: int = 50_000, each: int = 16):
        self.capacity, self.each = capacity, each
        self.held: OrderedDict[str, list[str]] = OrderedDict()

    def put(self, key: str, peers: list[str]) -> None:
        self.held[key] = peers[: self.each]
        if len(self.held) > self.capacity:
            self.held.popitem(last=False)

    def take(self, key: str) -> list[str]:
        return self.held.pop(key, [])


def latest_hints(seen: DataFrame, most_peers: int = 16) -> DataFrame:
    """The batch form of the hint cache: peers of the latest sighting with any, by id."""
    with_peers = seen.where(T.is_id(F.col("infohash")) & (F.size("peers") > 0))
    return with_peers.groupBy(F.lower("infohash").alias("id")).agg(F.slice(F.max_by("peers", "sighting_id"), 1, most_peers).alias("peers"))


def address_vote(votes: Iterable[str], *, least: int = 8, lead: int = 2, most: int = 32) -> Iterator[str | None]:
    """After each vote the accepted address: eight votes and twice the runner-up; all counts halve beyond 32."""
    counts: Counter = Counter()
    accepted = None
    for v in votes:
        counts[v] += 1
        if sum(counts.values()) > most:
            counts = Counter({k: n // 2 for k, n in counts.items() if n // 2})
        ranked = counts.most_common(2)
        second = ranked[1][1] if len(ranked) > 1 else 0
        if ranked and ranked[0][1] >= least and ranked[0][1] >= lead * second:
            accepted = ranked[0][0]
        yield accepted


def token_bucket(times: Iterable[float], rate: float) -> list[bool]:
    """Which requests a bucket of capacity ``rate`` (1 at least), refilled at ``rate`` a second, lets pass."""
    capacity = max(rate, 1.0)
    level, last, out = capacity, None, []
    for t in times:
        level = min(capacity, level + (0 if last is None else (t - last) * rate))
        last = t
        out.append(level >= 1.0)
        level -= out[-1]
    return out


def newest_nodes(seen: DataFrame, order: str, most: int = 65_536) -> DataFrame:
    """The batch form of the node queue: the last ``most`` rows of the order."""
    return seen.orderBy(F.desc(order)).limit(most)


def node_queue(nodes: Iterable[str], most: int = 65_536) -> list[str]:
    return list(deque(nodes, maxlen=most))

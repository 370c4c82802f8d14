"""Scenarios of catalogue, ranking, pipeline, feeds and streams on tiny tables."""

import functools
import json

import pytest
from pyspark.sql import functions as F

from skeinery import schema
from skeinery.functions import text as T
from skeinery.functions import vectors as V
from skeinery.operators import analytics as A
from skeinery.operators import catalog as C
from skeinery.operators import kept
from skeinery.operators import pipeline as P
from skeinery.operators import rank as R
from skeinery.operators import vector_search as VS
from skeinery.operators.fulltext import Index
from skeinery.plans.queries_streaming import QUERIES as STREAMS
from skeinery.session import parts_for
from skeinery.sources import config, feeds, tables
from skeinery.streaming import streams as S

NOW = 1_000_000
STATE = "id string, metadata_status string, first_seen bigint, last_seen bigint, seen_count bigint, fetch_attempts int, last_attempt bigint, hot_seen bigint, hot_count int, hint_peers bigint, probe_peers bigint, probe_at bigint"


def state(id_, status="pending", last=NOW, seen=1, tries=0, tried=0, hot=None, hint=0, peers=-1, at=0):
    return (id_, status, 1, last, seen, tries, tried, hot, 0, hint, peers, at)


def test_rrf_and_boost(spark):
    def ranked(ids):
        return spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "id string, pos int")

    got = [r["id"] for r in R.fused([(ranked("abc"), 1.0), (ranked("cda"), 1.0)]).orderBy(F.desc("score"), "first").collect()]
    assert got[:2] == ["a", "c"]
    rows = spark.createDataFrame([("a", 1.0, "video"), ("b", 1.2, "audio")], "id string, score double, category string")
    assert R.boosted(rows, category="video").orderBy(F.desc("score")).first()["id"] == "a"
    cut = R.relative_cut(spark.createDataFrame([("a", 1.0), ("b", 0.81), ("c", 0.79)], "id string, score double"), least=0.2)
    assert {r["id"] for r in cut.collect()} == {"a", "b"}


def test_rerank_gate(spark):
    rows = spark.createDataFrame([("a", 0, "glass"), ("b", 1, "harbor moon"), ("c", 40, "harbor")], "id string, pos int, name string")
    got = R.reranked(rows, "harbor moon", text="name").collect()
    assert [r["id"] for r in got] == ["b", "a", "c"] and got[0]["best"] == pytest.approx(6.0)
    assert R.lexical_evidence(rows, "zz harbor").first()["evidence"] and not R.lexical_evidence(rows, "zz yy").first()["evidence"]


def test_queue_and_purge(spark):
    s = spark.createDataFrame([state("live", peers=50, at=NOW - 10), state("old", peers=50, at=NOW - 90_000), state("hot", hot=NOW - 5), state("tired", tries=3, tried=1, peers=9, at=NOW - 10), state("got", "fetched", peers=9, at=NOW - 10)], STATE)
    q = [(r["id"], r["arm"]) for r in P.fetch_queue(s, NOW, 4).orderBy("place").collect()]
    assert q == [("hot", 0), ("live", 1)]
    after = {r["id"]: r["fetch_attempts"] for r in P.marked_tried(s, P.fetch_queue(s, NOW, 4), NOW).collect()}
    assert after["hot"] == 1 and after["old"] == 0
    p = spark.createDataFrame([state("dead", last=1, peers=0, at=5), state("gone", "unreachable", last=1), state("stale", at=NOW - 4000), state("both", tries=1, at=NOW - 30_000), state("tried", tries=1, peers=2, at=NOW - 30_000), state("keep")], STATE)
    assert {r["id"]: r["action"] for r in P.purge(p, NOW).collect()} == {"dead": "dead", "gone": "unreachable", "stale": "reset", "both": "reset", "tried": "tried", "keep": "keep"}
    assert [r["id"] for r in P.triage_queue(s, 5).collect()] == ["hot"]


def test_every_other_item_is_judged_again(spark):
    rows = spark.range(50_003).select(F.format_string("%040x", "id").alias("id"), F.when(F.col("id") < 50_000, "plain").otherwise("show s01e02").alias("name"), F.expr("cast(null as array<struct<path:string,size:bigint>>)").alias("files"), F.lit("other").alias("category"))
    assert {(r["id"], r["category"]) for r in P.recategorized(rows).collect()} == {(f"{i:040x}", "video") for i in range(50_000, 50_003)}
    assert [r["id"] for r in P.recategorized(rows, 2).collect()] == [f"{i:040x}" for i in (50_000, 50_001)]


def test_dashboards(spark):
    items = spark.createDataFrame([("a", 100, True), ("b", 100 + 7200, True), ("c", 100 + 7200, False)], "id string, first_seen bigint, fetched boolean")
    rows = A.discovery(items, now=100 + 7300, width=3600, points=3).collect()
    assert [r["n"] for r in rows] == [1, 0, 1]
    log = spark.createDataFrame([("x", 10, 1), ("x", 20, 7), ("x", 30, 0), ("x", 700, -1), (None, 1, 5), ("x", None, 2)], "name string, ts bigint, n bigint")
    assert {(r["bucket"], r["value"]) for r in A.metric_buckets(log).collect()} == {(0, 8), (None, 2)}
    files = spark.createDataFrame([("a", 0, "d/e/f", 5), ("a", 1, "d/g", 2), ("a", 2, "h", 1)], "id string, ord int, path string, size bigint")
    assert {(r["folder"], r["bytes"], r["files"]) for r in A.path_rollup(files).collect()} == {("d", 7, 2), ("d/e", 5, 1)}
    rate = spark.createDataFrame([("x", 1, 10.0), ("x", 2, 20.0)], "k string, t int, v double")
    assert A.smoothed(rate, key="k", order="t", value="v").first()["average"] == pytest.approx(13.0)
    found = spark.createDataFrame([("q", 1, "other"), ("q", 2, "glass harbor"), ("e", 1, "noise")], "query string, rank int, name string")
    wanted = spark.createDataFrame([("q", ["harbor"]), ("e", [])], "query string, wanted array<string>")
    r = A.evaluation(found, wanted).first()
    assert (r["queries"], r["hit_rate"], r["mrr"], r["empty_ok"]) == (1, 1.0, 0.5, 0.0)


def test_paging_plan_and_sequence(spark):
    rows = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 40, "0").alias("id"), (F.col("id") % 7).alias("first_seen"), F.lit(True).alias("fetched"))
    got = C.sequenced(rows.repartition(5))
    want = [r["id"] for r in rows.orderBy("first_seen", "id").collect()]
    assert [r["id"] for r in got.orderBy("seq").collect()] == want
    known = got.select("id", "seq")
    late = spark.createDataFrame([("z" * 40, -5, True), ("y" * 40, 3, True)], "id string, first_seen bigint, fetched boolean")
    then = {r["id"]: r["seq"] for r in C.sequenced(rows.unionByName(late), known).collect()}
    assert then == {r["id"]: r["seq"] for r in known.collect()} | {"z" * 40: 1001, "y" * 40: 1002}  # an older first sighting moves no earlier number
    page = C.changes_since(got, 10, 5)
    assert [r["seq"] for r in page.collect()] == [11, 12, 13, 14, 15]
    plan = C.page(rows, C.sort_order("added"), 3, 2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_no_nested_loop_in_search(spark):
    from skeinery.plans.queries_search import QUERIES

    plan = QUERIES["fts_match"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


def test_partition_estimates(spark):
    assert parts_for(spark.range(10), 1 << 20, least=3) >= 1
    assert parts_for(spark.createDataFrame([(1,)], "a int"), 1 << 20, least=3) == 3


def test_vector_search_variants_agree(spark):
    rows = spark.range(3000).select(F.col("id").cast("string").alias("id"), F.col("id").alias("seq"), F.lit(8).alias("dim"), F.lit(0.01).cast("float").alias("scale"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: ((F.xxhash64("id", i) % 127).cast("tinyint"))).alias("q")).repartition(6)
    q = [3, -5, 100, 0, 7, -90, 11, 64]
    a = [tuple(r) for r in VS.nearest(rows, q, 0.02, k=25, least=0.1).select("id", F.round("score", 9)).collect()]
    b = [tuple(r) for r in VS.nearest_columns(rows, q, 0.02, k=25, least=0.1).select("id", F.round("score", 9)).collect()]
    assert a == b and len(a) == 25
    hexed = rows.withColumn("id", F.lpad("id", 40, "0"))
    c = VS.nearest_packed(VS.packed(hexed, 8, block=700), q, 0.02, k=25, least=0.1).select("id", F.round("score", 9))
    assert [(r[0].lstrip("0"), r[1]) for r in c.collect()] == [(i.lstrip("0"), x) for i, x in b]
    assert VS.nearest_packed(VS.packed(hexed.limit(0), 8), q, 0.02, k=3).collect() == []
    assert VS.quantized_query([0.0, 0.0]) == ([0, 0], 0.0)


def test_vector_store(spark, tmp_path):
    """Mapped blocks and the table form give what the row form gives; ties by write order, also across blocks."""
    rows = spark.range(2000).select(F.lpad(F.col("id").cast("string"), 40, "0").alias("id"), F.col("id").alias("seq"), F.lit(8).alias("dim"), F.lit(0.01).cast("float").alias("scale"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: ((F.xxhash64(F.col("id") % 700, i) % 127).cast("tinyint"))).alias("q")).repartition(5)
    q = [3, -5, 100, 0, 7, -90, 11, 64]
    store = VS.VectorStore.write(rows, 8, f"file://{tmp_path}/store", block=300)
    for k, least in ((40, float("-inf")), (25, 1.0), (5, 1e9)):
        want = [tuple(r) for r in VS.nearest(rows, q, 0.02, k=k, least=least).collect()]
        assert [tuple(r) for r in store.nearest(q, 0.02, k=k, least=least).collect()] == want
        table = VS.VectorStore(spark, 8, blocks=VS.packed(rows, 8, 300))
        assert [tuple(r) for r in VS.nearest_any(table, q, 0.02, k=k, least=least).collect()] == want
    assert VS.VectorStore.write(rows.limit(0), 8, f"file://{tmp_path}/none").nearest(q, 0.02, k=3).collect() == []
    assert len(store.files) >= 5 and VS._local("hdfs://a/b") is None
    with pytest.raises(ValueError):
        store.nearest(q[:3], 1.0, k=1)


def test_kept_tables_follow_their_sources(spark, tmp_path):
    folder = str(tmp_path)
    spark.range(3).write.parquet(f"{folder}/numbers.parquet")
    built = []

    def build():
        built.append(1)
        return spark.read.parquet(f"{folder}/numbers.parquet").withColumn("twice", F.col("id") * 2)

    assert kept.table(spark, folder, "twice", ["numbers"], build).count() == 3
    assert kept.table(spark, folder, "twice", ["numbers"], build).count() == 3 and len(built) == 1
    spark.range(4).write.mode("append").parquet(f"{folder}/numbers.parquet")
    assert kept.table(spark, folder, "twice", ["numbers"], build).count() == 7 and len(built) == 2


def test_text_index_prunes_and_matches_many_queries_at_once(spark, tmp_path):
    docs = spark.createDataFrame([("a", "Harbor Light", "x/y.mkv"), ("b", "harbour", ""), ("c", "moon", "light")], "id string, name string, paths string")
    index = Index.build(docs).write(str(tmp_path))
    plan = index.ranked("harbor mo")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,harbor)" in plan and "StringStartsWith(term,mo)" in plan
    asked = ["zzz", "moon harbor", "light harb", "moo", "", "!"]
    assert sorted(r["n"] for r in index.matching(asked).collect()) == [2, 3]
    assert index.matching([]).collect() == [] and index.matching([""]).collect() == []
    assert {r["id"] for r in index.ranked("harb").collect()} == {"a", "b"}
    assert [tuple(r) for r in Index.build(docs).ranked("light").orderBy("id").collect()] == [tuple(r) for r in index.ranked("light").orderBy("id").collect()]


def test_tokens():
    assert config.token_matches("secret", "secret") and config.token_matches(None, "") and not config.token_matches(None, "x") and not config.token_matches("secreT", "secret")


def test_name_list_source(spark, tmp_path):
    path = tmp_path / "names.txt"
    path.write_text("  Tidal Clock \n\n   \nVelvet Meridian\n")
    assert [r["line"] for r in tables.text_lines(spark, str(path)).collect()] == ["Tidal Clock", "Velvet Meridian"]


def test_dates_and_median(spark):
    shown = spark.createDataFrame([(1_757_500_000,), (0,), (None,)], "t bigint").select(T.date_short(F.col("t")), T.date_full(F.col("t"))).collect()
    assert [tuple(r) for r in shown] == [("10.09.25", "10.09.2025 10:26:40"), ("–", ""), ("–", "")]
    tries = spark.createDataFrame([("ok", 5), ("ok", 9), ("ok", 7), ("ok", 7), ("timeout", 1), ("odd", None)], "outcome string, ms bigint")
    r = A.outcome_summary(tries).first()
    assert (r["n"], r["ok"], r["timeout"], r["other"], r["median_ms"]) == (6, 4, 1, 1, 7)
    none = A.outcome_summary(tries.where("outcome = 'odd'")).first()
    assert (none["ok"], none["median_ms"]) == (0, None)


def test_feeds(spark, tmp_path):
    rows = [{"id": f"{i:040x}", "name": f"n{i}", "total_size": i, "files": [{"path": "a", "size": 1}] if i % 2 else None, "first_seen": 1, "last_seen": 2, "seen_count": 1, "seq": i} for i in range(1, 8)]
    path = tmp_path / "changes.json"
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    feeds.register(spark)
    got = spark.read.format("skeinery_changes").option("url", str(path)).option("since", 2).option("limit", 2).load()
    assert sorted(r["seq"] for r in got.collect()) == [3, 4, 5, 6, 7]
    assert feeds.fetch_page(str(path), 6, 5)["more"] is False and feeds.fetch_page(str(path), 7, 5) == {"records": [], "cursor": 7, "more": False}
    lines = spark.createDataFrame([('{"id": "x", "total_size": 3}',), ("broken",), (None,)], "value string")
    assert [r["id"] for r in feeds.parsed_records(lines).collect()] == ["x"]


def test_streams_equal_batch(spark, tmp_path):
    schema = "sighting_id bigint, infohash string, source string, peers array<string>, repeats bigint, seen_at bigint, arrived_at timestamp_ntz"
    data = [(i, f"{i % 5:040x}", "announce" if i % 3 == 0 else "sample", ["p"] if i % 4 == 0 else None, i % 2, 100 + i, None) for i in range(40)]
    folder = str(tmp_path / "sightings.parquet")
    for part in (data[:15], data[15:], data[:1]):  # one delivery comes twice
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    once = spark.createDataFrame(data, schema)
    want = {tuple(r) for r in P.rollup(P.sightings(once)).collect()}
    got = S.rollup_batches(S.table_stream(spark, str(tmp_path), "sightings", files_each=10))
    assert {tuple(r) for r in got.select(*P.rollup(P.sightings(once)).columns).collect()} == want
    stream = S.table_stream(spark, str(tmp_path), "sightings", files_each=1).select(F.col("infohash").alias("k"), "sighting_id")
    out = spark.read.parquet(S.run_to_end(S.fifo_deduplicated(stream, key="k", order="sighting_id", capacity=8, shards=1), "t"))
    assert out.where("is_new").count() == 5 and out.count() == 41


def test_stream_dedup_of_unordered_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "table_stream", functools.partial(S.table_stream, files_each=1))
    for part in ([(1, 100), (2, 90)], [(3, 0), (1, 100), (4, 40)], [(2, 90), (5, 1), (None, 2)]):  # days of arrival
        rows = spark.createDataFrame(part, "sighting_id bigint, day int")
        rows = rows.select("sighting_id", F.lit("x").alias("infohash"), F.timestamp_seconds(F.col("day") * 86_400).cast("timestamp_ntz").alias("arrived_at"))
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "sightings.parquet"))
    assert sorted(r["sighting_id"] for r in STREAMS["stream_dedup"](spark, str(tmp_path)).collect()) == [1, 2, 3, 4, 5]


def test_stream_metrics_of_unordered_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "table_stream", functools.partial(S.table_stream, files_each=1))
    parts = [[("x", 90_000, 1), ("y", 5, 2)], [("x", 10, 4), ("x", 90_001, 8)], [("y", 5, 16), ("y", 40_000, 32), ("x", None, 64), ("x", 20, 0), (None, 1, 5)]]
    for part in parts:
        spark.createDataFrame(part, "name string, ts bigint, n bigint").coalesce(1).write.mode("append").parquet(str(tmp_path / "metric_log.parquet"))
    got = {(r["name"], r["bucket"], r["value"]) for r in STREAMS["stream_metrics"](spark, str(tmp_path)).collect()}
    assert got == {("x", 90_000, 9), ("x", 0, 4), ("x", None, 64), ("y", 0, 18), ("y", 39_600, 32)}


def test_stream_correlation(spark, tmp_path):
    for name, schema, rows in (("a", "txid string, sent timestamp", [("x", 0), ("y", 0)]), ("b", "txid string, received timestamp", [("x", 10), ("y", 50), ("z", 1)])):
        df = spark.createDataFrame(rows, "txid string, s int").select("txid", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias(schema.split(" ")[2]))
        df.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    joined = S.correlated(S.table_stream(spark, str(tmp_path), "a"), S.table_stream(spark, str(tmp_path), "b"))
    assert [r["txid"] for r in spark.read.parquet(S.run_to_end(joined, "c")).collect()] == ["x"]


def test_packet_stream(spark, tmp_path):
    body = b"d1:rd7:samples40:" + b"\x01" * 20 + b"\x02" * 20 + b"e1:t2:xy1:y1:re"
    rows = [(bytearray(body), 5), (bytearray(b"junk"), 6), (None, 7)]
    spark.createDataFrame(rows, "packet binary, received bigint").coalesce(1).write.parquet(str(tmp_path / "p"))
    out = spark.read.parquet(S.run_to_end(S.sampled_ids(S.packet_stream(spark, str(tmp_path / "p"))), "packets"))
    assert sorted((r["infohash"], r["seen_at"]) for r in out.collect()) == [("01" * 20, 5), ("02" * 20, 5)]


def test_schema_and_settings(spark, tmp_path):
    rows = spark.createDataFrame([("a", "3", "x")], "id string, total_size string, other string")
    r = schema.conformed(rows, "torrents").first()
    assert r["total_size"] == 3 and r["files"] is None and schema.empty(spark, "sightings").count() == 0
    for name, fields in schema.TABLES.items():
        assert spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").columns == fields.names
    path = tmp_path / "s.toml"
    path.write_text('sync_mode = "remote"\npage_limit = 9000\nunknown = 1\nmin_score = 0.2\n')
    s = config.load([str(path), "/none"], {"SKEINERY_SYNC_URL": "http://x", "SKEINERY_SEMANTIC": "no"})
    assert (s.sync_mode, s.page_limit, s.min_score, s.semantic) == ("remote", 500, 0.2, False)
    assert config.load([str(path)], {}).sync_mode == "local"


def test_pooling(spark):
    df = spark.createDataFrame([([[3.0, 0.0], [0.0, 4.0], [9.0, 9.0]], [1, 1, 0])], "s array<array<double>>, m array<int>")
    r = df.select(V.mean_pooled(F.col("s"), F.col("m")).alias("a"), V.last_pooled(F.col("s"), F.col("m")).alias("b")).first()
    assert r["a"] == pytest.approx([0.6, 0.8]) and r["b"] == pytest.approx([0.0, 1.0])


def test_synced_changes_and_guard(spark, tmp_path):
    rows = [("a", "one", 1), ("b", "two", 2), ("a", "newer", 3)]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "id string, name string, seq bigint").select("id", "name", F.lit(1).cast("bigint").alias("total_size"), F.lit(None).cast("array<struct<path:string,size:bigint>>").alias("files"), F.lit(1).cast("bigint").alias("first_seen"), F.lit(2).cast("bigint").alias("last_seen"), F.lit(1).cast("bigint").alias("seen_count"), "seq").coalesce(1).write.mode("append").parquet(str(tmp_path / "changes.parquet"))
    got = S.synced(S.table_stream(spark, str(tmp_path), "changes", files_each=1))
    assert {(r["id"], r["name"]) for r in got.collect()} == {("a", "newer"), ("b", "two")}
    seen = []
    write = S.guarded(lambda batch, n: seen.append(n), lambda: len(seen) > 0)
    write(None, 1)
    write(None, 2)
    assert seen == [1]
    (tmp_path / "names.txt").write_text("a b\n\n  c \n")
    assert [r["line"] for r in tables.text_lines(spark, str(tmp_path / "names.txt")).collect()] == ["a b", "c"]


def test_search_engine(spark):
    from skeinery.functions.vectors import embed_text
    from skeinery.operators.fulltext import Index
    from skeinery.operators.search import Engine, Request

    rows = [(f"{i:040x}", n, 100, 1, 1, i, i, 1, c, True, False) for i, (n, c) in enumerate([("Glass Harbor 2003", "video"), ("Harbor Songs", "audio"), ("Paper Moon", "video"), ("Moon Garden Game", "game")])]
    items = spark.createDataFrame(rows, "id string, name string, total_size bigint, file_count bigint, first_seen bigint, last_seen bigint, seen_count bigint, peer_count bigint, category string, fetched boolean, garbled boolean")
    index = Index.build(items.select("id", "name", F.lit("").alias("paths")))
    vectors = items.select("id", F.col("last_seen").alias("seq"), V.embedded_int8(F.col("name"), 32).alias("x")).select("id", "seq", F.lit(32).alias("dim"), F.col("x.scale").alias("scale"), F.col("x.q").alias("q"))
    e = Engine(items, index, vectors, 0.1, lambda t: embed_text(t, 32).tolist(), R.lexical_score)

    def names(request):
        return [r["name"] for r in e.search(request).rows.collect()]

    assert names(Request(text="harb")) == ["Harbor Songs", "Glass Harbor 2003"]
    assert names(Request(text="movies")) == ["Paper Moon", "Glass Harbor 2003"]
    assert names(Request(text="")) == ["Moon Garden Game", "Paper Moon", "Harbor Songs", "Glass Harbor 2003"]
    found = e.search(Request(text="habror"))
    assert found.corrected == "harbor" and found.rows.count() == 2
    assert e.search(Request(text="qqzzxx")).weak
    assert names(Request(text="moon about paper with glass", mode="hybrid"))[0] == "Paper Moon"
    assert names(Request(text="paper moon story", mode="semantic", limit=1)) == ["Paper Moon"]
    assert names(Request(text="moon", keep=C.Filter(category="game"))) == ["Moon Garden Game"]

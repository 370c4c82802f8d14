"""Text, name, binary, vector and spelling kernels on small cases."""

import hashlib
import sqlite3
from dataclasses import asdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skeinery.functions import binary as B
from skeinery.functions import names as N
from skeinery.functions import text as T
from skeinery.functions import vectors as V
from skeinery.functions.spell import Vocabulary, edit_distance, fuzzy_join, skeleton
from skeinery.functions.understanding import understand
from skeinery.operators import pipeline as P
from skeinery.operators.fulltext import Index, compile_query


def one(spark, column, schema="x string", value=""):
    return spark.createDataFrame([(value,)], schema).select(column.alias("r")).first()["r"]


def test_release_names():
    p = N.parse_name("Velvet.Meridian.1997.720p.WEB-DL.x265-QRS")
    assert (p.title, p.year, p.resolution, p.tags, p.release_group) == ("Velvet Meridian", 1997, 720, ["web-dl", "x265"], "QRS")
    p = N.parse_name("Copper.Lantern.S02E07.1080p.HDTV.x264-ABCD")
    assert (p.title, p.season, p.episode) == ("Copper Lantern", 2, 7)
    p = N.parse_name("Marble 3x11 [720p]")
    assert (p.season, p.episode, p.resolution) == (3, 11, 720)
    p = N.parse_name("1984.Quiet.Valley.2009.720p")  # a year that begins the title isn't the year
    assert (p.title, p.year) == ("1984 Quiet Valley", 2009)
    assert N.parse_name("").title == N.parse_name("-").title == N.parse_name(None).title == ""


def test_names_in_columns_equal_the_plain_parser(spark):
    names = ["Velvet.Meridian.1997.720p.WEB-DL.x265-QRS", "Copper.Lantern.S02E07.1080p.HDTV.x264-ABCD", "Marble 3x11 [720p]", "1984.Quiet.Valley.2009.720p", "", "-", " -x", "x-", "a--b", "web.Only", "Tidal s99999e1 2001-2002", "s1 e2", "\u3000Tidal\u00a0Clock-\u00c9t\u00e9 ", "one-two three-four_5", "Год 2011 рус 4K-ÄÖ", "x264 x264 2010 2011 web web", "A\tB\x07C\nD-E", "s123456789012345678901", "- - 1999", None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    for r in df.select("i", N.parsed(F.col("n")).alias("p")).collect():
        assert r["p"].asDict() == asdict(N.parse_name(names[r["i"]])), names[r["i"]]


def test_document_texts():
    files = [f"Tidal Clock.S02/Tidal.Clock.S02E1{i}.mkv" for i in (0, 1, 2)] + ["Tidal Clock.S02/Extras/Interview.mp4"]
    d = N.doc_text_with_files("Tidal Clock.S02.Pack", "video", files)
    assert d == "Tidal Clock season 2 — movie video — files: Tidal Clock S02E10 mkv Interview mp4"  # episodes count once
    many = N.doc_text_with_files("Shelf", "book", [f"chapter {'xyz'[i % 3] * (i + 1)}.txt" for i in range(60)], 150)
    assert len(many.encode()) < 220
    assert N.normalize_name("{Crew} Tidal_Clock.07 [BD].mkv") == "Crew Tidal Clock 07 BD mkv"


@pytest.mark.parametrize(
    ("text", "semantic", "keyword", "category", "years"),
    [
        ("uzay konulu dizileri bulur musun", "space dizileri", "space", "video", None),
        ("1970'lerin caz albümleri", "caz albümleri", "caz", "audio", (1970, 1979)),
        ("90s jazz albums", "jazz albums", "jazz", "audio", (1990, 1999)),
        ("house of lanterns", "house lanterns", "house lanterns", None, None),
        ("series about volcanoes", "series volcanoes", "volcanoes", "video", None),
        ("find me a debian image", "debian image", "debian image", None, None),
    ],
)
def test_understanding(text, semantic, keyword, category, years):
    p = understand(text)
    assert (p.semantic_text, p.keyword_text, p.category, p.year_range) == (semantic, keyword, category, years)


def test_understanding_of_category_words():
    assert understand("kitaplar").category_only and understand("bütün diziler").category == "video"
    assert understand(" \t ") == understand(None)
    assert understand("quiet river 2011").year == 2011


def test_spelling(spark):
    v = Vocabulary([("lantern", 14), ("meridian", 9), ("granite", 22), ("orchard", 7), ("velvet", 31), ("lentern", 1), ("marble", 4)])
    assert [v.suggest(w) for w in ("lantrn", "meridan", "grnite", "orchrd", "vlevet")] == ["lantern", "meridian", "granite", "orchard", "velvet"]
    assert v.suggest("granite") is v.suggest("zephyrus") is v.suggest("abc") is None
    assert v.corrected("meridan orchrd") == "meridian orchard" and v.corrected("granite 2011") is None
    assert "meridian orchard" in v.candidates("meridan orchrd", 24)
    assert edit_distance("tb", "bqt", 3) == 3 and edit_distance("vlevet", "velvet", 2) == 1  # no part is edited twice
    terms = spark.createDataFrame([("lantern", 14), ("meridian", 9), ("velvet", 31)], "term string, doc bigint")
    words = spark.createDataFrame([("vlevet",), ("velvet",), ("meridan",), ("lentren",), (None,), ("ab",)], "word string")
    assert {(r["word"], r["term"], r["distance"]) for r in fuzzy_join(words, terms).collect()} == {("vlevet", "velvet", 1), ("meridan", "meridian", 1), ("lentren", "lantern", 2)}


@given(st.text(alphabet="abcdeiouyxz", min_size=1, max_size=12))
@settings(max_examples=50, deadline=None)
def test_skeleton_is_stable(w):
    s = skeleton(w)
    assert s[0] == w[0] and len(s) <= len(w) and not any(a == b for a, b in zip(s, s[1:]))


def test_columns(spark):
    assert one(spark, T.percent_encoded(F.col("x")), value="a b~c*d-e_f.g/ü") == "a%20b~c%2Ad-e_f.g%2F%C3%BC"
    assert one(spark, T.folded(F.col("x")), value="ÉTÉ ışık İZ naïve") == "ete ısık iz naive"
    assert one(spark, T.skeleton(F.col("x")), value="Potter") == "ptr"
    assert one(spark, T.is_id(F.col("x")), value="a" * 40) and not one(spark, T.is_id(F.col("x")), value="a" * 39 + "\n")
    cases = {"Show S01E02 1080p": "video", "Album [FLAC]": "audio", "Thing-PLAZA": "game", "Photo office": "software", "novel ebook": "book", "plain": "other"}
    for name, category in cases.items():
        assert one(spark, T.category(F.col("x"), F.lit(None).cast("array<struct<path:string,size:bigint>>")), value=name) == category
    archive = F.array(F.struct(F.lit("a.b/c.ZIP").alias("path"), F.lit(1).alias("size")))
    assert one(spark, T.category(F.col("x"), archive), value="plain") == "archive"
    assert one(spark, T.human_size(F.col("x")), "x bigint", 1536) == "1.5 KB"


def test_bencode_and_messages():
    assert B.value_length(b"d2:hii7eerest") == 9 and B.value_length(b"i42e:") == 4 and B.value_length(b"l2:abi0ee") == 9
    for bad in (b"", b"l" * 150 + b"e" * 150, b"7:short", b"d2:hi", b"i4-e", b"888888888888888:z"):
        assert B.value_length(bad) is None
    node = b"\x09" * 20 + bytes([93, 184, 4, 7]) + (40_001).to_bytes(2, "big")
    m = B.dht_message(b"d1:rd5:nodes26:" + node + b"7:samples40:" + b"\xaa" * 20 + b"\xbb" * 20 + b"e1:t1:k1:y1:re")
    assert m["kind"] == "response" and m["nodes"] == [("93.184.4.7", 40_001)] and m["samples"] == ["aa" * 20, "bb" * 20]
    q = B.dht_message(b"d1:ad9:info_hash20:" + b"\x5c" * 20 + b"4:porti50123ee1:q13:announce_peer1:t1:z1:y1:qe")
    assert (q["method"], q["port"], q["info_hash"]) == ("announce_peer", 50_123, "5c" * 20)
    assert B.dht_message(b"no bencode at all") is None and B.dht_message(None) is None
    assert B.peer_values([bytes([127, 9, 8, 7, 6, 5]), bytes([93, 184, 4, 7, 0, 0]), b"tiny"]) == []


def test_peer_messages(spark):
    assert B.extension(None)["kind"] is None and B.extension(b"\0\0\0\x09\x14")["kind"] is None
    frame = lambda kind, number, body: (len(body) + 2).to_bytes(4, "big") + bytes([kind, number]) + body
    assert B.extension(frame(20, 0, b"d1:md11:ut_metadatai2eee"))["metadata_size"] == 0
    assert B.extension(frame(20, 0, b"d1:mi3ee"))["kind"] == B.extension(frame(5, 0, b"xx"))["kind"] == B.extension(frame(20, 1, b"broken"))["kind"] == "other"
    m = B.extension(frame(20, 2, b"d8:msg_typei1e5:piecei4ee" + b"payload"))
    assert (m["kind"], m["msg_type"], m["piece"]) == ("metadata", 1, 4)
    assert one(spark, B.handshake(F.col("x")), "x binary", b"\x13BitTorrent protocoX" + bytes(48)) is None
    assert one(spark, B.handshake(F.col("x")), "x binary", b"short") is None


def test_info_dictionaries():
    r = B.info_record(b"d5:filesld6:lengthi7e4:pathl8:tide.mp3eed6:lengthi5e4:pathl4:text9:cover.txteee4:name5:clocke")
    assert r["total_size"] == 12 and r["files"] == [("clock/tide.mp3", 7), ("clock/text/cover.txt", 5)]
    assert B.info_record(b"d6:lengthi77ee")["error"] == "name"
    assert B.info_record(b"d6:lengthi-8e4:name3:fige")["error"] == "length"
    assert B.info_record(b"l3:figi2ee")["error"] == "not a dictionary" and B.info_record(None)["error"] == "bencode"
    legacy = "海边".encode("gbk")
    both = b"d6:lengthi9e4:name%d:%b10:name.utf-87:seasidee" % (len(legacy), legacy)
    assert B.info_record(both)["name"] == "seaside"
    whole, digest = B.assemble([(2, b"gh"), (0, b"cd"), (1, b"ef")])
    assert whole == b"cdefgh" and digest == hashlib.sha1(b"cdefgh").hexdigest()


def test_legacy_text():
    for s, e in (("海边 的 灯塔", "gbk"), ("よるのとしょかん テレビ 第12巻 [720p].mkv", "shift_jis"), ("Тихая река", "cp1251"), ("푸른 바다", "euc_kr"), ("Gümüş saat – 時計", "utf-8")):
        assert B.legacy_text(s.encode(e)) == s


def test_public_peers(spark):
    rows = [("93.184.4.7", 4000), ("93.184.4.7", 443), ("10.20.30.40", 4000), ("172.16.9.9", 4000), ("172.33.0.5", 4000), ("100.100.3.3", 4000), ("198.18.200.1", 4000), ("93.184.4", 4000), (None, 4000), ("256.1.1.1", 4000)]
    df = spark.createDataFrame(rows, "ip string, port int")
    got = [(r["ip"], r["port"]) for r in df.where(B.is_public_peer(F.col("ip"), F.col("port"))).collect()]
    assert got == [("93.184.4.7", 4000), ("172.33.0.5", 4000)]


def test_vectors(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal(256)
    q, scale = V.int8(v)
    assert np.abs(q * scale - v).max() <= scale / 2 + 1e-12
    df = spark.createDataFrame([(v.tolist(), [0.0] * 256)], "a array<double>, z array<double>")
    r = df.select(V.quantized(F.col("a")).alias("a"), V.quantized(F.col("z")).alias("z"), V.cosine(F.col("a"), F.col("a")).alias("c")).first()
    assert list(r["a"]["q"]) == q.tolist() and r["a"]["scale"] == pytest.approx(scale)
    assert r["z"]["scale"] == 0 and set(r["z"]["q"]) == {0} and r["c"] == pytest.approx(1)
    a, b, c = (V.embed_text(t, 64) for t in ("tidal clock tower", "tidal clock", "marble orchard"))
    assert a @ b > a @ c and np.array_equal(a, V.embed_text("tidal clock tower", 64))


def test_bounded_structures():
    assert P.fifo_new("abcab", 2) == [True] * 5 and P.fifo_new("abab", 8) == [True, True, False, False]
    cache = P.HintCache(capacity=2, each=1)
    for k in "abc":
        cache.put(k, [k, "x"])
    assert cache.take("a") == [] and cache.take("b") == ["b"] and cache.take("b") == []
    assert list(P.address_vote(["a"] * 8))[-1] == "a" and list(P.address_vote(["a", "b"] * 8))[-1] is None
    assert P.token_bucket([0.0] * 12 + [1.0] * 12, 10) == [True] * 10 + [False] * 2 + [True] * 10 + [False] * 2
    assert P.node_queue("abcd", 2) == ["c", "d"]


def test_bm25_equals_fts5(spark):
    docs = [("1", "glass harbor harbor", "a/harbor.mkv b/moon.srt"), ("2", "paper moon", "harbors/x.txt"), ("3", "garden", "y z"), ("4", "Émile harbour", "q"), ("5", "other thing", "w"), ("6", "more", "v u t s")]
    c = sqlite3.connect(":memory:")
    c.execute("create virtual table f using fts5(name, paths, id unindexed, tokenize='unicode61 remove_diacritics 2')")
    c.executemany("insert into f values (?, ?, ?)", [(n, p, i) for i, n, p in docs])
    index = Index.build(spark.createDataFrame(docs, "id string, name string, paths string"))
    for text in ("harbor", "harb moon", "emile", "glass harbor", "nothing"):
        match = " ".join(f'"{t}"*' for t in compile_query(text))
        want = dict(c.execute("select id, bm25(f, 10.0, 1.0) from f where f match ?", (match,)).fetchall())
        got = {r["id"]: r["score"] for r in index.ranked(text).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
    assert index.ranked("  ..  ").collect() == [] and index.count(None).first()["n"] == 0
    assert compile_query("17.09") == ["17", "09"] and compile_query("17.09", split=False) == ["1709"]


def test_kept_index_reads_by_prefix(spark, tmp_path):
    docs = [(str(i), f"word{i % 97} harbor{i % 3}", "") for i in range(2000)]
    built = Index.build(spark.createDataFrame(docs, "id string, name string, paths string"))
    kept = built.write(str(tmp_path))
    hits = kept.matches("word5 harbor1")
    assert {r["id"] for r in hits.collect()} == {r["id"] for r in built.matches("word5 harbor1").collect()}
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,word5)" in plan and "Python" not in plan

"""Problems 7, 8 and 9 against independent implementations and brute force."""

import base64
import bisect
import collections
import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from skeinery.llm import byte_bpe, packing, spans, tokens


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.for_worker(tokens.default_vocabulary())


@pytest.fixture(scope="module")
def other(bpe):
    with open(tokens.default_vocabulary(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=byte_bpe.SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


@given(st.text(max_size=200))
@settings(max_examples=300, deadline=None)
def test_encoder_equals_merge_loop(bpe, other, s):
    ids = bpe.encode(s)
    assert ids == other.encode_ordinary(s) and bpe.decode(ids) == s


def test_encoder_on_hard_texts(bpe, other):
    rng = random.Random(3)
    texts = ["<|endoftext|>", " " * 5000, "\n\n\t x", "a" * 20_000, "0123456789" * 3000, "абв" * 2000, "🙂👩‍🚀" * 500, "=" * 4001, "ﷺ\u0000​", "".join(rng.choice("abcdefg<>|_- \n") for _ in range(30_000)), "".join(chr(rng.randrange(0x20, 0x3000)) for _ in range(8000))]
    for s in texts:
        assert bpe.encode(s) == other.encode_ordinary(s)


DOC_SCHEMA = "doc_id bigint, text string, k string, t string, ids string, n_tokens string"


def docs(spark, pairs):
    """Documents with extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, s, "k", "t", "ids", "n") for i, s in pairs], DOC_SCHEMA)


def test_corpus_encoding(spark, other):
    rows = [(1, "Harbor glass 12"), (2, None), (3, ""), (None, "x y"), (1, "Harbor glass 12"), (4, "z" * 50_000)]
    got = tokens.encode_ids(docs(spark, rows), ids_each=3)
    assert got.columns == ["doc_id", "ids"]
    want = sorted(((i, other.encode_ordinary(s or "")) for i, s in rows), key=repr)
    assert sorted(((r["doc_id"], r["ids"]) for r in got.collect()), key=repr) == want
    back = {r["doc_id"]: r["text"] for r in tokens.decode_ids(got).collect()}
    assert back[1] == "Harbor glass 12" and back[2] == "" and back[4] == "z" * 50_000
    counts = tokens.count_tokens(docs(spark, rows))
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in counts.collect()), key=repr) == sorted(((i, len(x)) for i, x in want), key=repr)
    assert tokens.encode_ids(docs(spark, [])).collect() == []


def fit(sizes, capacity, rule):
    """Containers needed one item at a time, longest first, into the most room or the least that fits."""
    rooms: list[int] = []
    for n in sorted(sizes, reverse=True):
        at = bisect.bisect_left(rooms, n) if rule == "longest" else len(rooms) - 1
        room = rooms.pop(at) if 0 <= at < len(rooms) and rooms[at] >= n else capacity
        bisect.insort(rooms, room - n)
    return len(rooms)


@pytest.mark.parametrize("rule", ["shortest", "longest"])
@pytest.mark.parametrize("seed", range(4))
def test_patterns_place_every_item_once(seed, rule):
    rng = random.Random(seed)
    histogram = {rng.randrange(1, 101): rng.randrange(1, 500) for _ in range(60)}
    patterns = packing.plan_patterns(dict(histogram), 100, rule)
    placed: dict[int, int] = {}
    for count, slots in patterns:
        assert sum(length * times for length, times in slots) <= 100
        for length, times in slots:
            placed[length] = placed.get(length, 0) + times * count
    assert placed == histogram
    assert sum(c for c, _ in patterns) == fit([k for k, v in histogram.items() for _ in range(v)], 100, rule)


@pytest.mark.parametrize("rule", ["shortest", "longest"])
def test_pack(spark, rule):
    rng = random.Random(1)
    items = [(i, 7 if i % 3 == 0 else rng.randrange(0, 40)) for i in range(3000)] + [(5000, 95), (5001, 40), (None, 12), (5002, None), (5003, -4), (1, 9), (1, 9)]
    df = spark.createDataFrame([(i, n, "x") for i, n in items], "k bigint, size bigint, n string")
    rows = packing.pack(df, key="k", size="size", capacity=40, rule=rule, bucket_rows=100).collect()
    assert sum(r["n"] for r in rows) == sum(n for _, n in items if n and n > 0)
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r["container"], []).append((r["position"], r["n"]))
    assert sorted(by) == list(range(len(by)))
    for slots in by.values():
        at = 0
        for position, n in sorted(slots):
            assert position == at
            at += n
        assert at <= 40
    assert [(r["piece"], r["start"], r["n"]) for r in sorted(rows, key=lambda r: r["piece"]) if r["k"] == 5000] == [(0, 0, 40), (1, 40, 40), (2, 80, 15)]
    assert len(by) == fit([r["n"] for r in rows], 40, rule)
    assert packing.pack(df.limit(0), key="k", size="size", capacity=40).collect() == []


def brute_spans(pairs, length):
    seen: dict[str, set] = {}
    texts = [(i, s) for i, s in pairs if i is not None and s is not None]
    for i, s in texts:
        for p in range(len(s) - length + 1):
            seen.setdefault(s[p : p + length], set()).add(i)
    out = {}
    for i, s in texts:
        mark = np.zeros(len(s), bool)
        for p in range(len(s) - length + 1):
            if len(seen[s[p : p + length]]) > 1:
                mark[p : p + length] = True
        edges = np.flatnonzero(np.diff(np.r_[0, mark.astype(int), 0]))
        out.setdefault(i, set()).update((int(a), int(b)) for a, b in zip(edges[::2], edges[1::2]))
    return {(i, a, b) for i, s in out.items() for a, b in s}


@pytest.mark.parametrize("most", [7, 13, 60, 140])
def test_difference_cover(most):
    period, cover = spans.difference_cover(most)
    assert period <= most and {(a - b) % period for a in cover for b in cover} == set(range(period))


@pytest.mark.parametrize(("length", "hot", "few"), [(20, 4096, 64), (20, 3, 64), (50, 4096, 2), (10, 2, 64), (20, 4096, 1)])
def test_spans_equal_brute_force(spark, monkeypatch, length, hot, few):
    rng = random.Random(length + hot)
    pool = ["".join(rng.choice("abcdé漢🙂 ") for _ in range(rng.randrange(5, 120))) for _ in range(25)]
    pairs = [(i, "".join(rng.choice(pool)[rng.randrange(4) :] for _ in range(rng.randrange(0, 5)))) for i in range(120)]
    boiler = "".join(rng.choice("xyz") for _ in range(70))
    pairs += [(1000 + i, "".join(rng.choice("qrs") for _ in range(15)) + boiler + str(i)) for i in range(40)]  # a third share one block
    pairs += [(2000 + i, "copy " * 20) for i in range(10)] + [(3000, "-" * 300), (3001, "-" * 90), (3002, "w" * 200), (None, boiler), (4000, None), (4001, ""), (4002, boiler[:length])]
    monkeypatch.setattr(spans._anchor_blobs, "__defaults__", (400,))  # flush often, so that crowds are met
    got = {(r["doc_id"], r["span_start"], r["span_end"]) for r in spans.shared_spans(docs(spark, pairs).repartition(4), length=length, hot=hot, few=few, bucket_anchors=50).collect()}
    assert got == brute_spans(pairs, length)


def test_a_window_in_every_document_is_spread(spark):
    """No bucket holds many of the anchors of a text that all documents share, and no anchor is lost."""
    boiler = "".join(random.Random(3).choice("abcdefgh") for _ in range(120))
    batch = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 100)), pa.array([f"{j:06d}" + boiler for j in range(i, i + 100)])], names=["doc", "t"]) for i in range(0, 2000, 100)]
    plain, spread = ({k: 0 for k in range(16)} for _ in range(2))
    kinds = collections.Counter()
    for few, counts in ((1 << 40, plain), (8, spread)):
        for b in spans._anchor_blobs(60, 16, few, chars_each=3000)(iter(batch)):
            for bucket, kind, n in zip(b["bucket"].to_pylist(), b["kind"].to_pylist(), b["n"].to_pylist()):
                size = int(np.frombuffer(n, np.uint32).sum())
                kinds[few, kind] += size
                counts[bucket] += size if kind != spans._MARK else 0
    assert sum(plain.values()) == sum(spread.values()) and kinds[8, spans._SURE] > 0.8 * sum(spread.values()) and kinds[8, spans._MARK] > 0
    assert max(plain.values()) > 3 * np.median(list(plain.values())) or min(plain.values()) == 0
    assert max(spread.values()) < 2 * np.median(list(spread.values()))


def test_spans_of_repeated_rows_and_share(spark):
    text = "abcdefghij" * 6
    df = docs(spark, [(1, text), (1, text), (2, "short"), (3, None), (4, "")])
    found = spans.shared_spans(df, length=20)
    assert found.collect() == []  # a document doesn't share with itself
    df = docs(spark, [(1, text), (2, "zz" + text), (3, None), (4, "")])
    share = {r["doc_id"]: (r["n_chars"], r["shared_chars"], r["share"]) for r in spans.shared_share(df, spans.shared_spans(df, length=20)).collect()}
    assert share == {1: (60, 60, 1.0), 2: (62, 60, 60 / 62), 3: (None, None, None), 4: (0, 0, 0.0)}
    assert spans.shared_spans(df.limit(0), length=20).collect() == []

"""Problem 4 against brute force."""

import random

import numpy as np
import pytest

from skeinery.llm.seen import NEW, Generations, HotKeys, PeeledFilter, error_rate, seen_before


@pytest.mark.parametrize("n", [0, 1, 2, 7, 1000, 40_000])
@pytest.mark.parametrize("bits", [8, 16, 32])
def test_filter_has_no_false_negatives_and_few_false_positives(n, bits):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**63, n).astype(np.uint64)
    f = PeeledFilter(np.r_[keys, keys[: n // 3]], bits)
    assert f.contains(keys).all()
    others = rng.integers(0, 2**63, 100_000).astype(np.uint64)
    assert f.contains(others).mean() < 3 * 2.0**-bits + 1e-4


def test_generations_answer_exactly_across_seals():
    rng = random.Random(5)
    state, known = Generations(64, 32), set()
    for _ in range(100):
        keys = [str(rng.randrange(3000)).encode() for _ in range(50)]
        h = np.array([hash(k) & (1 << 63) - 1 for k in keys], np.uint64)
        for k, s in zip(keys, state.test_and_add(keys, h)):
            assert (s != NEW) == (k in known)
            known.add(k)
    assert len(state.filters) > 5 and 0 < state.error() < 1e-6


def test_reported_error_is_the_measured_one():
    """Eight-bit filters answer wrongly often enough to be counted."""
    rng = np.random.default_rng(3)
    state, known = Generations(64, 8), set()
    wrong = expected = 0.0
    for _ in range(300):
        keys = [int(k).to_bytes(8, "little") for k in rng.integers(0, 200_000, 1000)]
        h = np.array([int.from_bytes(k, "little") for k in keys], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        chance = state.error()
        how = state.test_and_add(keys, h)
        for k, s in zip(keys, how):
            wrong += s != NEW and k not in known
            known.add(k)
        expected += (how == NEW).sum() * chance / (1 - chance)
    assert len(state.filters) > 10 and wrong > 1000
    assert abs(expected - wrong) < 0.2 * wrong


def test_hot_keys_are_few_and_have_occurred():
    rng = random.Random(2)
    hot, known, caught = HotKeys(8), set(), 0
    for _ in range(20_000):
        k = b"hot" if rng.random() < 0.34 else str(rng.randrange(5000)).encode()
        s = hot.seen(k)
        assert not s or k in known
        known.add(k)
        caught += s and k == b"hot"
        assert len(hot.count) <= 8
    assert caught > 5000


def test_answers_come_from_sealed_filters(spark):
    """A stream whose keys fill many batches is answered by the filters, exactly, and the rate is told."""
    rng = random.Random(4)
    rows = [(o, str(rng.randrange(6000)).encode()) for o in range(30_000)]
    tested = seen_before(spark.createDataFrame(rows, "o bigint, k binary").repartition(3), order="o", key="k", batch_keys=64)
    r = error_rate(tested).first()
    assert r["answers"] == 30_000 and r["seen"] == 30_000 - len({k for _, k in rows})
    assert r["from_filter"] > 0.7 * r["seen"] and r["from_slice"] + r["from_batch"] + r["from_filter"] == r["seen"]
    assert 0 < r["wrong_rate"] < 1e-6


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for o in range(4000):
        k = b"hot" if rng.random() < 0.34 else str(rng.randrange(1500)).encode()
        rows += [(o, k, "x")] * (3 if rng.random() < 0.05 else 1)
    rows += [(None, b"hot", "x"), (9999, None, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "o bigint, k binary, seen string").repartition(5)
    got = {r["o"]: r["seen"] for r in seen_before(df, order="o", key="k", batch_keys=100).collect()}
    known, want = set(), {}
    for o, k in sorted({(o, k) for o, k, _ in rows if o is not None and k is not None}):
        want[o] = k in known
        known.add(k)
    assert got == want


def test_empty(spark):
    df = spark.createDataFrame([], "o bigint, k binary")
    assert seen_before(df, order="o", key="k").collect() == []

"""Problems 1, 2, 3, 5 and 6 against brute force on small tables."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest

from skeinery.llm import heavy, knn, mojibake, near_dup, terms


def test_burst_trie_counts():
    rng = random.Random(2)
    words = ["".join(rng.choice("abé0") for _ in range(rng.randrange(1, 9))) for _ in range(5000)]
    trie = terms.BurstTrie(burst=8)
    for w in words:
        trie.add(w, 2, 1)
    got = {}
    for prefix, box in trie.leaves.items():
        assert len(box) <= 8 and not trie.inner & {prefix}
        for suffix, c in box.items():
            got[(prefix + suffix)[:-1]] = c
        assert {s for s, _, _ in terms._unpacked(*terms._packed(prefix, box)[1:])} == set(box)
    assert got == {w: [2 * n, n] for w, n in Counter(words).items()}


@pytest.mark.parametrize(("burst", "routes", "most", "group"), [(2048, 200_000, 400_000, 500_000), (4, 200_000, 50, 500_000), (3, 10, 30, 7), (2048, 0, 50, 3)])
def test_term_counts(spark, burst, routes, most, group):
    rng = random.Random(burst)
    words = ["harbor", "Glass", "ÉTÉ", "x264", "漢字", "a", "ab", "abc", "İZ", "Σίσυφος ΟΔΟΣ", "ⅷ", "one_two", "1.5"]
    names = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 6))) for _ in range(300)] + [None, "", "  ", "harbor " * 5000]
    df = spark.createDataFrame([(n, "x", "y") for n in names], "name string, prefix string, term string").repartition(5)
    occurrences, records = Counter(), Counter()
    for n in names:
        found = terms.terms_of(n or "")
        occurrences.update(found)
        records.update(set(found))
    got = {r["term"]: (r["occurrences"], r["records"]) for r in terms.term_counts(df, text="name", burst=burst, most_routes=routes, most_terms=most, group_terms=group).collect()}
    assert got == {t: (occurrences[t], records[t]) for t in occurrences}
    marks = {r["term"]: r["mark"] for r in terms.marked_terms(df, text="name").collect()}
    whole = sum(1 for n in names if n)
    assert all(marks[t] == ("rare" if records[t] < 3 else "common" if records[t] > 0.05 * whole else None) for t in records)
    assert terms.term_counts(df.limit(0), text="name").collect() == []


def test_heavy_items(spark):
    rng = random.Random(4)
    items = [f"i{int(rng.paretovariate(0.7))}" for _ in range(20_000)] + ["hot"] * 9000
    rows = [(x, rng.randrange(-1, 4), "c") for x in items] + [(None, 5, "c"), ("nul", None, "c")]
    df = spark.createDataFrame(rows, "item string, w bigint, cell string").repartition(7)
    weight = Counter()
    for x, w, _ in rows:
        if x is not None and w is not None and w > 0:
            weight[x] += w
    total = sum(weight.values())
    got = {r["item"]: r for r in heavy.heavy_items(df, item="item", weight="w", share=0.01, depth=3, width=512).collect()}
    tree = heavy.heavy_items(df, item="item", weight="w", share=0.01, depth=3, width=512, fan_in=2).collect()
    assert {r["item"] for r in tree} >= {x for x, w in weight.items() if w >= 0.01 * total} and all(r["weight_lower"] <= weight[r["item"]] <= r["weight_upper"] for r in tree)
    for x, w in weight.items():
        if w >= 0.01 * total:
            assert x in got
    for x, r in got.items():
        assert r["weight_lower"] <= weight[x] <= r["weight_upper"] and r["total_weight"] == total
    assert heavy.heavy_items(df.limit(0), item="item", weight="w", share=0.1).collect() == []
    same = heavy.heavy_items(spark.createDataFrame([("a",)] * 9, "item string"), item="item", weight=None, share=0.5).collect()
    assert [(r["item"], r["weight_lower"], r["weight_upper"]) for r in same] == [("a", 9, 9)]


def exact_neighbours(vectors, k):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 12)
    np.fill_diagonal(s, -9)
    return {i: [ids[j] for j in np.lexsort((np.arange(len(ids)), -s[n]))[: min(k, len(ids) - 1)]] for n, i in enumerate(ids)}


@pytest.mark.parametrize("options", [{}, {"cell_size": 60, "fine_size": 20, "part": 25, "query_part": 100}])
def test_neighbours(spark, options):
    rng = np.random.default_rng(5)
    centres = rng.integers(-90, 90, (12, 16))
    vectors = {f"v{i:04d}": np.clip(centres[i % 12] + rng.integers(-25, 26, 16), -127, 127).tolist() for i in range(700)}
    vectors |= {f"copy{i:03d}": [5] * 16 for i in range(350)}  # a third are equal
    bad = [("zero", [0] * 16), ("short", [1] * 15), ("null", None), ("hole", [None] + [1] * 15), (None, [1] * 16)]
    df = spark.createDataFrame([(i, q, 1) for i, q in [*vectors.items(), *bad]], "id string, q array<tinyint>, c int").repartition(4)
    rows = knn.neighbours(df, key="id", vector="q", dim=16, k=5, **options).collect()
    want = exact_neighbours(vectors, 5)
    got: dict = {}
    for r in sorted(rows, key=lambda r: (r["id"], r["rank"])):
        got.setdefault(r["id"], []).append(r["neighbour"])
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    recall = np.mean([len(set(got[i]) & set(want[i])) / 5 for i in want])
    assert recall >= (0.9 if options else 0.999)
    assert got["copy000"] == want["copy000"] and got["copy300"] == want["copy300"]
    one = spark.createDataFrame([("a", [1] * 16)], "id string, q array<tinyint>")
    assert knn.neighbours(one, key="id", vector="q", dim=16).collect() == []
    assert knn.neighbours(one.limit(0), key="id", vector="q", dim=16).collect() == []


def test_scan_abandons_without_losing():
    rng = np.random.default_rng(6)
    m = knn.unit(rng.integers(-99, 99, (800, 64))) @ knn.rotation(64)
    q = m[:40] + 0.05 * rng.standard_normal((40, 64)).astype(np.float32)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    s = q @ m.T
    i, j, score = knn.scan(q, np.full(40, 0.8, np.float32), m, 5)
    want = {(a, b) for a, b in zip(*np.nonzero(s >= 0.8))}
    assert set(zip(i.tolist(), j.tolist())) == want and np.allclose(score, s[i, j], atol=1e-5)


def jaccard_pairs(records, share):
    sets = {i: near_dup.runs_of(s) for i, s in records.items()}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]) - 1e-9}


@pytest.mark.parametrize("options", [{}, {"least_hot": 1, "most_hot": 10, "tile": 16, "rows_each": 200}, {"least_hot": 1, "most_hot": 1000, "tile": 2, "rows_each": 50}])
def test_near_duplicates(spark, options):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    records: dict[str, list] = {}
    for i in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 40))]
        for j in range(rng.randrange(1, 6)):
            edited = [w if rng.random() > 0.03 else rng.choice(vocabulary) for w in base]
            records[f"r{i:03d}{j}"] = [" ".join(edited), "common start here " + " ".join(edited[:5])]
    records |= {f"same{i:03d}": ["exact Copy of it", None, ""] for i in range(90)}
    records |= {"nil": [None], "blank": ["", " .. "], "none": None, "one": ["One"], "one2": ["one "], "long": ["word " * 20_000]}
    rows = [(i, s, "c") for i, s in records.items()] + [("nil", [None], "c"), (None, ["exact copy of it"], "c")]
    df = spark.createDataFrame(rows, "id string, strings array<string>, runs string").repartition(4)
    found = near_dup.Records(df, key="id", strings="strings", share=0.7, **options)
    pairs = [(r["id_a"], r["id_b"]) for r in found.record_pairs().collect()]
    want = jaccard_pairs({i: s or [] for i, s in records.items()}, 0.7)
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    root = {i: i for i in records}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in want:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    links = Counter(x for p in want for x in p)
    assert {r["id"]: (r["group_id"], r["links"]) for r in found.groups().collect()} == {i: (top(i), links[i]) for i in records}


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "id string, strings array<string>")
    found = near_dup.Records(df, key="id", strings="strings")
    assert found.record_pairs().collect() == [] and found.groups().collect() == []


def test_bit_sliced_distances():
    rng = np.random.default_rng(9)
    n = 300
    size = rng.integers(20, 120, n)
    prints = rng.integers(0, 2**63, (n, 4)).astype(np.uint64)
    prints[50:200] = prints[0] ^ (np.uint64(1) << rng.integers(0, 20, (150, 4)).astype(np.uint64))
    group = np.sort(rng.integers(0, 4, n))
    size = size[np.lexsort((size, group))]
    i, j = near_dup.bit_sliced_pairs(group, np.zeros(n, np.int32), size, prints, 0.7, each=37)
    d = np.bitwise_count(prints[:, None] ^ prints[None]).sum(2)
    want = {(a, b) for a in range(n) for b in range(a + 1, n) if group[a] == group[b] and d[a, b] <= (0.3 / 1.7) * (size[a] + size[b]) + 1e-9 and min(size[a], size[b]) >= 0.7 * max(size[a], size[b]) - 1e-9}
    assert set(zip(i.tolist(), j.tolist())) == want and want


GOOD = ["мельница дождь", "Первый снег зима", "güneş dağ yıldız", "çocuk şehir", "corazón español", "Straße größer", "物語 ロボット 海辺", "電影 山城 森林", "기계 이야기 하늘", "λίμνη δρόμος", "þoka áður líf", "zürich “quoted”", "naïve café №7", "żółty wąż piękna"]


def test_garbled_text(spark):
    rng = random.Random(10)
    clean = [" ".join(rng.sample(g.split() * 2, 2)) + f" part{i}" for i in range(60) for g in GOOD]
    broken = {
        "мельница дождь".encode().decode("latin-1"): "мельница дождь",
        "güneş".encode().decode("latin-1"): "güneş",
        "corazón español".encode().decode("cp1252").encode().decode("cp1252"): "corazón español",
        "мельница дождь".encode("cp1251").decode("latin-1"): "мельница дождь",
        "мельница дождь".encode("koi8-r").decode("cp1251"): "мельница дождь",
        "物語 海辺".encode("cp932").decode("cp1251"): "物語 海辺",
        "güneş dağ".encode("cp1254").decode("latin-1"): "güneş dağ",
        "Straße größer".encode().decode("cp437"): "Straße größer",
        "dir/기계 이야기".encode("cp949").decode("gbk"): "dir/기계 이야기",
    }
    rows = [(f"c{i}", [s, None, "", "plain ascii"], "x") for i, s in enumerate(clean)] + [(f"b{i}", ["ok", s], "x") for i, s in enumerate(broken)]
    rows += [("lost", ["ni�o"], "x"), ("none", None, "x"), ("long", ["é" * 30_000], "x"), ("b0", ["ok", next(iter(broken))], "x")]
    df = spark.createDataFrame(rows, "id string, strings array<string>, text string").repartition(3)
    got = {(r["id"], r["ord"]): r["repaired"] for r in mojibake.garbled_strings(df, key="id", strings="strings").collect()}
    assert got.pop(("lost", 0)) is None
    assert got == {(f"b{i}", 1): s for i, s in enumerate(broken.values())}
    assert mojibake.garbled_strings(df.limit(0), key="id", strings="strings").collect() == []


def test_integer_keys(spark):
    df = spark.createDataFrame([(1, ["a b c d"]), (2, ["A b c d"]), (3, ["x"])], "id bigint, strings array<string>")
    assert [tuple(r) for r in near_dup.Records(df, key="id", strings="strings").record_pairs().collect()] == [("1", "2")]
    vectors = spark.createDataFrame([(1, [1, 2]), (2, [1, 2]), (3, [2, -1])], "id bigint, q array<tinyint>")
    near = {(r["id"], r["rank"]): (r["neighbour"], r["score"]) for r in knn.neighbours(vectors, key="id", vector="q", dim=2, k=2).collect()}
    assert near[1, 1] == (2, 1.0) and near[1, 2] == (3, 0.0) and near[3, 1] == (1, 0.0) and near[3, 2] == (2, 0.0)

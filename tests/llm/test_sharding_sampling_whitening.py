"""Shards, importance draws and whitening against brute force, and on odd and empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from tickloom.llm import importance as I
from tickloom.llm import sharding as S
from tickloom.llm import whitening as W

SCHEMA = "doc_id long, text string, size int, hash string, unit string, shard string, rank string, score string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"Wörd{k % 991}" for k in range(200_000))
TEXTS = [(None, None), (1, ""), (2, "a"), (3, "B c d"), (3, "B c d"), (3, "other"), (4, None), (5, LONG), (None, "lost one"), (6, "ÄÖ Äö straße"), *[(100 + k, f"word{k % 7} " * (k % 31)) for k in range(400)]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 0, "x", "x", "x", "x", "x") for i, t in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def fewest(sizes, capacity):
    n, load = 1, 0
    for x in sizes:
        n, load = (n, load + x) if load + x <= capacity else (n + 1, x)
    return n


def check_shards(rows, texts, shards):
    assert sorted((r["doc_id"] is None, r["doc_id"], r["size"], r["text_crc32"]) for r in rows if r["doc_id"] is not None) == sorted((False, i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts if i is not None)
    assert {r["law"] for r in rows} <= {"bytes"} and all(r["grown_shard"] is None and 0 <= r["shard"] < shards for r in rows)
    slots, by_text = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        by_text[r["size"], r["text_crc32"]].add(r["shard"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(len(v) == 1 for v in by_text.values())


@pytest.mark.parametrize("shards", [1, 2, 7, 24])
def test_shards_hold_the_smallest_capacity(docs, shards):
    rows = S.shard_documents(docs, shards).collect()
    check_shards(rows, TEXTS, shards)
    # Brute force: hot texts by repeated removal, then the smallest capacity by trying every sum of neighbours.
    texts, loads, units = Counter(), Counter(), Counter()
    for _, t in TEXTS:
        texts[t or ""] += len((t or "").encode()) + 8
    hot = []
    while len(hot) < shards - 1:
        t, n = max(texts.items(), key=lambda x: x[1])
        if n * (shards - len(hot)) < texts.total():
            break
        hot.append(t)
        del texts[t]
    for t, n in texts.items():
        units[int(hashlib.md5(t.encode()).hexdigest()[:4], 16) >> 2] += n
    sizes = [units[u] for u in sorted(units)]
    best = min(c for a in range(len(sizes)) for b in range(a, len(sizes)) if fewest(sizes, c := sum(sizes[a : b + 1])) <= shards - len(hot) and c >= max(sizes))
    for r in rows:
        loads[r["shard"]] += r["size"]
    assert max(loads[s] for s in range(len(hot), shards)) <= best
    assert sum(1 for s in range(shards) if loads[s]) >= len(hot) + fewest(sizes, best)


def test_hot_copies_and_tables_without_rows(spark, empty):
    assert S.shard_documents(empty).collect() == []
    texts = [(k, "the same long text " * 20) for k in range(3000)] + [(k, f"text {k} " * 9) for k in range(3000, 7000)]
    rows = S.shard_documents(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    check_shards(rows, texts, 24)
    loads = Counter()
    for r in rows:
        loads[r["shard"]] += r["size"]
    rest = sorted(loads.values())[:-1]
    assert len(loads) == 24 and max(rest) < 1.1 * min(rest)  # the copies have one shard, the others share evenly
    rows = S.shard_documents(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()
    assert {r["shard"] for r in rows} == {0} and sorted(r["slot"] for r in rows) == [0, 1]


def test_a_search_step_needs_as_many_shards_as_filling_in_order(spark):
    rng = np.random.default_rng(1)
    for _ in range(6):
        sizes = [int(x) for x in rng.integers(1, 100, rng.integers(1, 40))]
        units = spark.createDataFrame([(k, n) for k, n in enumerate(sizes)], "unit int, size long")
        for m in (1, 3, 8):
            capacity, cuts = S.capacity_and_cuts(units, m)
            assert capacity == min(c for c in range(max(sizes), sum(sizes) + 1) if fewest(sizes, c) <= m)
            parts = np.split(sizes, cuts)
            assert len(parts) <= m and max(p.sum() for p in parts) <= capacity


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def runs(text, n):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


@pytest.mark.parametrize(("n", "buckets", "percent"), [(1, 10_000, 10), (3, 97, 50), (2, 1, 100)])
def test_importance(spark, docs, n, buckets, percent):
    items = [None, "", "word1 word2 Straße", "word3 " * 50]
    target = spark.createDataFrame([(t,) for t in items], "text string")
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, d in TEXTS for f in runs(d, n)), Counter(bucket(f) for d in items for f in runs(d, n))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    expected = []
    for i, d in TEXTS:
        f = runs(d, n)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        expected.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(d))])
    able = sorted((-x[3], x[0] is None, x[0] or 0, k) for k, x in enumerate(expected) if x[4] >= 20)
    place = {row[-1]: r + 1 for r, row in enumerate(able[: len(able) * percent // 100])}
    key = lambda x: tuple((v is not None, v or 0) for v in x)
    expected = sorted(([*x[:4], place.get(k)] for k, x in enumerate(expected)), key=key)
    found = I.importance_sample(docs, target, n=n, buckets=buckets, percent=percent).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted((list(r) for r in found), key=key) == expected


def test_importance_without_rows(spark, docs, empty):
    assert I.importance_sample(empty, docs).collect() == []
    assert I.importance_sample(docs, empty).count() == len(TEXTS)


def test_ring_gives_the_same_hashes_in_pieces(monkeypatch):
    text = LONG[:5000].encode()
    expected = sorted(zlib.crc32(f.encode()) for f in runs(text.decode(), 4))
    monkeypatch.setattr(I, "PIECE", 64)
    assert sorted(h for part in I.feature_hashes(text, 4) for h in part) == expected
    assert I._words_of_runs(len(expected), 4) == len(words(text.decode()))
    assert [list(I.pieces(t, 4)) for t in (b"", b"   ", b"abcdefgh", b"Ab cdefgh i")] == [[], [[]], [[b"abcdefgh"]], [[b"ab", b"cdefgh"], [b"i"]]]


def exact(vectors):
    """Whitened values and shares by exact fractions up to the decomposition."""
    x = [[math.floor(64 * Fraction(c)) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    v = np.array([[float(Fraction(sum((r[i] * n - s[i]) * (r[j] * n - s[j]) for r in x), n**3)) for j in range(d)] for i in range(d)])
    values, e = np.linalg.eigh(v)
    centred = np.array([[float(Fraction(r[j] * n - s[j], n)) for j in range(d)] for r in x])
    order = np.argsort(-values)
    return n, values[order] / values.sum(), centred @ e[:, order] / np.sqrt(values[order]), [sum((r[j] * n - s[j]) ** 2 for j in range(d)) for r in x]


@pytest.mark.parametrize("scale", [1.0, 1e5, 1e17])
def test_whitening(spark, scale):
    rng = np.random.default_rng(0)
    vectors = [[float(c) for c in v] for v in (rng.normal(size=(60, 6)) * [1, 2, 3, 4, 5, 6] + 7) * scale]
    odd = [(900, None), (901, []), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (903, [float("nan")] + [1.0] * 5), (904, [float("inf")] + [1.0] * 5), (905, [1.0])]
    table = spark.createDataFrame([*enumerate(vectors), (3, vectors[3]), *odd], "vec_id long, embedding array<double>").selectExpr("*", "1 as n", "2 as component").repartition(4)
    rows = W.whiten(table, most=4).collect()
    n, shares, white, deviations = exact([*vectors, vectors[3]])
    assert len(rows) == 4 * n and {r["n"] for r in rows} == {n} and max(r["identity_error"] for r in rows) < 1e-6
    for k in range(1, 5):
        mine = {r["vec_id"]: r for r in rows if r["component"] == k}
        z = np.array([mine[i]["whitened"] for i in range(60)])
        expected = white[:60, k - 1]
        assert np.allclose(z * np.sign(z @ expected), expected, atol=1e-8) and abs(mine[0]["explained"] / shares[k - 1] - 1) < 1e-9
        assert [int(mine[i]["deviation_digits"]) for i in range(60)] == deviations[:60]
        assert [mine[i]["deviation"] for i in range(60)] == [v if v < 2**63 else None for v in deviations[:60]]


def test_whitening_of_large_values_and_without_variance(spark):
    kind = "vec_id long, embedding array<float>"
    assert W.whiten(spark.createDataFrame([], kind)).collect() == []
    assert W.whiten(spark.createDataFrame([(1, None), (2, [None])], kind)).collect() == []
    assert W.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, kind)).collect() == []
    rows = W.whiten(spark.createDataFrame([(k, [float(k), 5.0]) for k in range(4)], kind)).collect()
    assert {r["component"] for r in rows} == {1} and len(rows) == 4
    huge = np.array([[1e300, -3.5], [2e10, 1e-9]])
    assert W.integers(huge).tolist() == [[math.floor(64 * Fraction(c)) for c in r] for r in huge]


def test_scatter_is_exact():
    rng = np.random.default_rng(2)
    for bits in (10, 30, 61):
        y = rng.integers(-(2**bits), 2**bits, (5000, 3))
        sums, products = W.scatter(y)
        whole = y.astype(object)
        assert sums.tolist() == whole.sum(0).tolist() and products.tolist() == (whole.T @ whole).tolist()

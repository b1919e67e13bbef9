"""Every operator against a brute-force version, and on odd and empty tables."""

import hashlib
import json
import math
import os
import re
import string
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.llm import exact_dedup as E
from tickloom.llm import jaccard_join as J
from tickloom.llm import lm_scores as LM
from tickloom.llm import mixing as M
from tickloom.llm import pii, quality, token_counts, toxicity
from tickloom.llm.buckets import bucket_counts
from tickloom.llm.common import SPACE_WORDS, text_chunks, word_hashes, words_of
from tickloom.llm.decontaminate import contamination, drop_contaminated
from tickloom.llm.graph import components
from tickloom.llm.html_text import extract_text, page_text
from tickloom.llm.oracles import ORACLES
from tickloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, sha string, h string, again string, sk string, w string, n string"
BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.tiktoken")
LONG = " ".join(f"w{k % 997}" for k in range(60_000))
PASSAGE = "one two three four five six seven eight nine ten eleven twelve"
ODD = [
    (None, None, None), (1, "", "a"), (2, None, "a"), (3, PASSAGE, "a"), (4, PASSAGE.upper(), "b"), (4, PASSAGE.upper(), "b"), (4, "other text", None), (5, LONG, "b"), (6, LONG + " tail", "b"), (None, "lost one", "a"), (7, "   ", "a"),
    (8, "ÄÖ äö Straße", "c"), (9, "short item", "c"), (10, "short item with more words than the item", "c"), (11, PASSAGE + " thirteen", "a"), (12, "mail a.b@c.example.com or +1 (523) 555-1055 or 4111 1111 1111 1111 or 10.0.0.1", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", s, 0, "x", "x", "x", "x", "x", "x", "x") for i, t, s in ODD], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(1, 13)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, PASSAGE), (2, "Short item"), (3, None), (4, "..."), (None, "lost one"), (2, "Short item")], "item_id long, text string")


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, (text or "").translate(LOWER))


def plain(v):
    return float(f"{v:.9g}") + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert found == sorted(([plain(r[names.index(c)]) for c in columns] for r in cursor.fetchall()), key=repr)


def test_buckets(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("x")).repartition(5)
    got = bucket_counts(df, lambda b: [b.column(0).to_numpy() * 3], 8, top=100_000)
    assert got.sum() == 1000 and got[[0, 3, 18]].tolist() == [143, 143, 142]
    assert bucket_counts(df, lambda b: [b.column(0).to_numpy() * 3] * 2, 17, top=3).sum() == 21


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100}


# Exact dedup


@pytest.mark.parametrize("log2", [None, 4])
def test_exact_groups(odd, log2):
    got = E.exact_groups(odd, log2=log2).collect()
    groups = defaultdict(list)
    for i, t, _ in ODD:
        groups[hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest()].append(i)
    assert len(got) == len(ODD)
    for r in got:
        ids = groups[r.text_sha256]
        best = max((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size) == (best, len(ids)) and (not r.kept or r.doc_id == best)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept) == set(groups) and set(kept.values()) == {1}


def test_ranges_keep_rows_from_the_shuffle(spark, monkeypatch):
    """With many more rows than one filter serves, most unique rows are still known to be so."""
    monkeypatch.setattr(E, "LOG2_MOST", 12)
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.when(F.col("id") < 300, F.col("id") % 100).otherwise(F.col("id"))).alias("text")).repartition(3)
    rows = df.withColumn("h", F.xxhash64("text"))
    marked = E.mark_repeated(rows, "h", 3000)
    got = marked.groupBy((F.col("doc_id") < 300).alias("twice"), "again").count().collect()
    found = {(r.twice, r.again): r["count"] for r in got}
    assert found[True, True] == 300 and (True, False) not in found and found.get((False, True), 0) < 60
    assert rows.withColumn("again", E.maybe_repeated(rows, "h", 3000)).filter("again").count() > 600
    sizes = E.exact_groups(df).groupBy("group_size", "kept").count().collect()
    assert {(r.group_size, r.kept): r["count"] for r in sizes} == {(1, True): 2700, (3, True): 100, (3, False): 200}
    assert E.exact_dedup(df.withColumnRenamed("doc_id", "a.b"), "a.b").count() == 2800 and E.exact_groups(df.withColumnRenamed("doc_id", "a.b"), "a.b").count() == 3000


def test_exact_rows(odd, empty):
    out = E.exact_dedup(odd)
    assert out.columns == odd.columns
    got = out.select("doc_id", "text").collect()
    assert Counter((r.text or "").translate(LOWER) for r in got) == Counter({(t or "").translate(LOWER) for _, t, _ in ODD})
    assert {r.doc_id for r in got if (r.text or "").translate(LOWER) == PASSAGE} == {4}
    assert E.exact_groups(empty).count() == E.exact_dedup(empty).count() == 0


def test_hot_text(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "Hot").otherwise(F.col("id").cast("string")).alias("text"))
    got = E.exact_groups(df).groupBy("group_size", "kept").count().collect()
    assert {(r.group_size, r.kept): r["count"] for r in got} == {(1, True): 2000, (1000, True): 1, (1000, False): 999}


# Decontamination


def brute_contamination(text, items):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    ws, hit, ids = words(text, pattern), set(), set()
    for item, t in items:
        iw = words(t, pattern)
        n = min(len(iw), 10)
        for a in range(len(iw) - n + 1 if n else 0):
            for b in range(len(ws) - n + 1):
                if ws[b : b + n] == iw[a : a + n]:
                    hit.update(range(b, b + n))
                    if item is not None:
                        ids.add(str(item))
    return len(ws), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


def test_contamination(odd, items, empty):
    pairs = [(r.item_id, r.text) for r in items.collect()]
    got = contamination(odd, items).collect()
    want = Counter((i, *brute_contamination(t, pairs)) for i, t, _ in ODD)
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
    kept = drop_contaminated(odd, items)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, t, _ in ODD if not brute_contamination(t, pairs)[4])
    assert contamination(empty, items).count() == 0
    assert contamination(odd, items.limit(0)).filter("contaminated").count() == 0


# Mixing


def brute_targets(sizes):
    """Raise a common level until the budget is spent."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, free, target = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        capped = [s for s in free if 2 * sizes[s] < level * weight[s]]
        if not capped:
            return target | {s: level * weight[s] for s in free}
        for s in capped:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


def test_mixing(odd, empty):
    got = M.mix_documents(odd).collect()
    sizes = defaultdict(int)
    for _, t, s in ODD:
        sizes[s] += len(words(t))
    targets = brute_targets(sizes)
    by_id = {}
    for r in got:
        by_id.setdefault((r.doc_id, r.size), []).append(r)
        assert 0 <= r.taken <= 2 * r.size
    for i, t, s in ODD:
        r = by_id[i, len(words(t))][0]
        assert r.source_size in sizes.values() and math.isclose(r.target, targets[s], rel_tol=1e-9, abs_tol=1e-9)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, M.mix_documents(odd.repartition(2)).collect()), key=repr)
    rows = M.mix_rows(odd)
    assert rows.columns == [*odd.columns, "mix_copy"] and rows.count() == sum(r.copies for r in got)
    assert M.mix_documents(empty).count() == M.mix_rows(empty).count() == 0


def test_mixing_meets_targets(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 40).cast("int")).alias("text"))
    got = M.mix_documents(df).toPandas().merge(df.select("doc_id", "source").toPandas(), on="doc_id")
    for _, g in got.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 20


# N-gram Jaccard join


def brute_similar(rows):
    sets = []
    for _, t in rows:
        ws = words(t)
        sets.append({tuple(ws[a : a + 5]) for a in range(max(len(ws) - 4, 1))} if ws else set())
    group = list(range(len(rows)))
    def find(k):
        while group[k] != k:
            k = group[k]
        return k
    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * len(sets[a] | sets[b]):
                group[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(find(k), []).append(i)
    return Counter((i, len(sets[k]), min((x for x in least[find(k)] if x is not None), default=None), len(least[find(k)])) for k, (i, _) in enumerate(rows))


def test_similar_odd(odd, empty):
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.group_size) for r in J.similar_documents(odd).collect())
    assert got == brute_similar([(i, t) for i, t, _ in ODD])
    kept = J.keep_one_of_similar(odd)
    assert kept.columns == odd.columns and Counter(r.doc_id for r in kept.collect())[5] == 1 and not kept.filter("doc_id = 6").count()
    assert J.similar_documents(empty).count() == J.keep_one_of_similar(empty).count() == 0


def test_similar_families(spark, monkeypatch):
    """Families around the threshold, a shared passage, and blocks smaller than the groups."""
    monkeypatch.setattr(J, "BLOCK", 8)
    rng = np.random.default_rng(5)
    word = lambda: f"v{rng.integers(0, 5000)}"
    rows = []
    for family in range(12):
        base = [word() for _ in range(int(rng.integers(8, 120)))]
        for _ in range(int(rng.integers(1, 14))):
            text = list(base)
            for _ in range(int(rng.integers(0, max(2, len(base) // 18)))):
                text[int(rng.integers(0, len(text)))] = word()
            rows.append((len(rows), " ".join(text)))
    passage = [word() for _ in range(30)]
    rows += [(len(rows) + k, " ".join([word() for _ in range(20)] + passage)) for k in range(25)]
    got = J.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.group_size) for r in got.collect()) == brute_similar(rows)


def test_tree_pairs_lose_nothing():
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 1 << 63, int(rng.integers(10, 200))).astype(np.uint64)
        sets += [np.unique(np.concatenate([base[: int(len(base) * rng.uniform(0.8, 1))], rng.integers(0, 1 << 63, 5).astype(np.uint64)])) for _ in range(10)]
    sets += [np.unique(np.concatenate([s, rng.integers(0, 1 << 63, 3).astype(np.uint64)])) for s in (rng.integers(0, 1 << 63, int(k)).astype(np.uint64) for k in (1000, 1000, 1021, 1028, 3000)) for _ in range(3)]
    n, bits = np.array([len(s) for s in sets]), [J.bitmap(s).tobytes() for s in sets]
    assert len({len(b) for b in bits}) > 2
    want = {(a, b) for b in range(len(sets)) for a in range(b) if 100 * (c := len(np.intersect1d(sets[a], sets[b]))) >= 75 * (n[a] + n[b] - c)}
    found = {(int(a), int(b)) for u, v in J.group_pairs(n, n, bits, np.arange(len(n))) for a, b in zip(u, v, strict=True)}
    assert want <= found and len(found) < len(sets) * (len(sets) - 1) / 4
    half = np.arange(len(n)) % 2
    across = {(int(a), int(b)) for u, v in J.group_pairs(n, n, bits, np.arange(len(n)), (half,)) for a, b in zip(u, v, strict=True)}
    assert {p for p in want if half[p[0]] != half[p[1]]} <= across and all(half[a] != half[b] for a, b in across)
    assert not list(J.group_pairs(n, n, bits, np.zeros(len(n), int)))


# Token counts


def test_token_counts_like_library(odd, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    rng = np.random.default_rng(0)
    alphabet = list("'srtvemld abXÉéΣσς1९٣½!.́ \x1c\x85\nß漢İ😀") + ["<|endoftext|>", "'re", "'ll"]
    texts = ["", None, LONG, "a" * 3000, "I'LL've 'RE", "<|startoftext|>x<|endoftext|>", *("".join(rng.choice(alphabet, int(rng.integers(0, 70)))) for _ in range(800))]
    got = token_counts.count_texts(texts, token_counts.WordBpe(BPE))
    assert got.tolist() == [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    rows = {r.doc_id: r for r in token_counts.token_counts(odd, BPE).collect()}
    assert rows[5].over_limit and rows[5].n_bytes == len(LONG) and rows[1].n_tokens == 0 and rows[8].n_bytes == len(ODD[11][1].encode())
    assert token_counts.token_counts(empty, BPE).count() == 0


def test_chunks_do_not_matter(monkeypatch):
    classes = np.random.default_rng(1).integers(0, 10, 5000).astype(np.uint8)
    tables = token_counts.compile_splitter()
    whole = token_counts.piece_starts(np.append(classes, token_counts.SPACE), tables)
    monkeypatch.setattr(token_counts, "CHUNK", 3)
    assert (token_counts.piece_starts(np.append(classes, token_counts.SPACE), tables) == whole).all()


# Classifiers


def recall_and_precision(df, name, label, sf="sf0.01"):
    """Of a label (0 or 1) among held-out documents."""
    got = df.toPandas().merge(pd.read_parquet(f"/root/testdata/{sf}/labels.parquet"), on="doc_id")
    held = got[got.held_out]
    assert ((got.score >= 0.3) == (got.predicted == 1)).all() and got.score.between(0, 1).all()
    right = ((held.predicted == label) & (held[name] == label)).sum()
    return right / (held[name] == label).sum(), right / (held.predicted == label).sum()


def test_quality(spark, odd, empty, labels):
    docs, truth = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality.quality_scores(docs, truth)
    assert out.count() == docs.count()
    good, bad = (recall_and_precision(out, "quality", v) for v in (1, 0))
    assert min(good) > 0.95 and min(bad) > 0.75
    rows = quality.quality_scores(odd, labels).collect()
    assert len(rows) == len(ODD) and all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0) for r in rows)
    assert quality.quality_scores(empty, labels).count() == 0 and quality.quality_scores(odd, labels.limit(0)).count() == len(ODD)
    assert quality.keep_quality(odd, labels).columns == odd.columns and quality.keep_quality(empty, labels).count() == 0
    scores = lambda found: sorted((str(r.doc_id), round(r.score, 9)) for r in found)
    assert scores(rows) == scores(quality.quality_scores(odd.repartition(1), labels).collect()) and len({r.score for r in rows if r.doc_id in (1, 2)}) == 1


def test_quality_fit_like_plain_newton(monkeypatch):
    """The fitted weights are where the gradient of the pairwise loss vanishes, and the cut has the most right decisions."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((300, quality.FEATURES))
    y = (x[:, 3] - x[:, 5] + 0.5 * rng.standard_normal(300) > 0).astype(int)
    model = quality.fit_pairs(x, y)
    spread = x.std(0)
    w = model.weights * spread
    pick = np.random.default_rng(quality.SEED)
    better, worse = pick.choice(np.flatnonzero(y == 1), quality.PAIRS), pick.choice(np.flatnonzero(y == 0), quality.PAIRS)
    d = (x[better] - x[worse]) / spread
    assert np.abs(d.T @ (1 / (1 + np.exp(d @ w))) / quality.PAIRS - quality.RIDGE * w).max() < 1e-6
    s = (x - model.mean) @ model.weights
    right = lambda t: ((s >= t) == (y == 1)).mean()
    assert right(model.cut) >= max(right(t) for t in np.quantile(s, np.linspace(0, 1, 401))) - 1e-9


def test_toxicity(spark, odd, empty, labels):
    docs, truth = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.toxicity_scores(docs, truth)
    assert out.count() == docs.count()
    recall, precision = recall_and_precision(out, "toxic", 1, "sf0.1")
    assert recall > 0.88 and precision > 0.92
    rows = toxicity.toxicity_scores(odd, labels).collect()
    assert len(rows) == len(ODD) and all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 4 == 2) for r in rows)
    assert toxicity.toxicity_scores(empty, labels).count() == 0 and toxicity.toxicity_scores(odd, labels.limit(0)).count() == len(ODD)
    for only in (0, 1):
        one = labels.withColumn("toxic", F.lit(only))
        assert {r.predicted for r in toxicity.toxicity_scores(odd, one).collect()} == {only}


def plain_buckets(text):
    out = set()
    for k in toxicity.SIZES:
        for i in range(len(text) - k + 1):
            h = 0
            for c in text[i : i + k]:
                h = (h * 0x01000193 + ord(c)) % (1 << 32)
            out.add(((h ^ (k * 0x27D4EB2F) % (1 << 32)) * 0x9E3779B1 % (1 << 32)) >> (32 - toxicity.LOG2))
    return out


def test_log_count_ratios_like_plain_counts(spark):
    """Ratios, features and scores against counts with Python sets and a plain gradient of the fitted loss."""
    rows = [(k, f"{'Bad woRd' if k % 5 == 0 else 'kind'} teXt no {k % 7}", int(k % 5 == 0)) for k in range(120)]
    docs, truth = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3), spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, truth)
    train = [(plain_buckets(t.translate(LOWER)), y) for k, t, y in rows if zlib.crc32(str(k).encode()) % 4 != 2]
    bad, good = Counter(g for s, y in train for g in s if y), Counter(g for s, y in train for g in s if not y)
    size, share = 1 << toxicity.LOG2, np.mean([y for _, y in train])
    whole = [sum(c.values()) + 0.5 * size for c in (bad, good)]
    ratio = lambda g: math.log((bad[g] + 0.5) / whole[0]) - math.log((good[g] + 0.5) / whole[1])
    term = lambda n, e: n * math.log(n / e) if n else 0
    proof = lambda g: term(bad[g], (bad[g] + good[g]) * share) + term(good[g], (bad[g] + good[g]) * (1 - share))
    keep = {g for g in set(bad) | set(good) if proof(g) >= toxicity.EVIDENCE}
    assert keep == set(np.flatnonzero(model.keep).tolist()) and {ratio(g) > 0 for g in keep} == {True, False}
    weights = {g: model.weights[g] / ratio(g) for g in keep}
    p = [1 / (1 + math.exp(-(model.bias + sum(model.weights[g] for g in s & keep)))) for s, _ in train]
    for g in keep:  # steps are scaled by the spread of a feature, so the penalty is too
        spread = math.sqrt(np.mean([(g in s) * ratio(g) ** 2 for s, _ in train])) + 1e-6
        slope = np.mean([(q - y) * (g in s) * ratio(g) for (s, y), q in zip(train, p, strict=True)])
        assert abs(slope / spread + toxicity.RIDGE * weights[g]) < 2e-2
    texts = pa.array([t for _, t, _ in rows])
    want = [1 / (1 + math.exp(-(model.bias + sum(model.weights[g] for g in plain_buckets(t.translate(LOWER)) & keep)))) for _, t, _ in rows]
    assert np.allclose(model.score(texts), want)


def test_ngrams_are_of_characters():
    data = "aé漢b".encode()
    got = list(toxicity.grams(np.frombuffer(data + b"zz", np.uint8), np.array([0, len(data), len(data) + 2])))
    assert [len(r) for r, _ in got] == [2, 1, 0, 0]


# Personal data


def brute_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        if 12 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    return sorted(out + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15])


def test_base_spans():
    rng = np.random.default_rng(4)
    alphabet = list("0123456789..@@+-() aB%_\n4")
    for _ in range(20_000):
        text = "".join(rng.choice(alphabet, int(rng.integers(0, 40))))
        assert pii.base_spans(text) == brute_spans(text)
    assert pii.base_spans("9" * 200_000) == [] and pii.base_spans("a@" * 50_000) == []


def test_personal_data(odd, empty, spark):
    rows = {r.doc_id: r for r in pii.digest(pii.personal_data(odd)).collect()}
    text = ODD[15][1]
    want = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in brute_spans(text))
    assert (rows[12].n_email, rows[12].n_ip, rows[12].n_card, rows[12].n_phone) == (1, 1, 1, 1)
    assert rows[12].base_sha256 == hashlib.sha256(want.encode()).hexdigest() and want in rows[12].spans
    assert rows[5].spans == "" and rows[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.personal_data(empty).count() == 0
    secret = spark.createDataFrame([(k, f'word {k} token = "{hashlib.sha1(str(k).encode()).hexdigest()}" and mail x{k}@y.com') for k in range(60)], "doc_id long, text string")
    assert all("secret" in r.spans for r in pii.digest(pii.personal_data(secret)).collect())


def test_added_spans_like_plain_loops(spark):
    """Candidates, posteriors, classifier and decisions against one loop over all texts; candidates never overlap."""
    rng = np.random.default_rng(6)
    bits = ["token = " + "aB3" * 90, "call 555 123 4567 now", "Dr. Anna Lee said", "mail joe(at)site(dot)com", "+1 (523) 555-1055", "a@b.co", "order 12345678", "2024-01-02 10", "Mr Stone", "word", "10.0.0.1", "isbn 978 3 16 148410", "secret: x1y2z3w4v5u6t7s8r9q0k"]
    texts = [" ".join(rng.choice(bits, int(rng.integers(0, 7)))) for _ in range(150)]
    got = {r.doc_id: r for r in pii.digest(pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4))).collect()}
    found, votes = [], Counter()
    for text in texts:
        base = pii.base_spans(text)
        some = base + pii.nominated(text, base)
        ends = sorted((s, e) for s, k, e in some if k >= 4) + [(10**9, 0)]
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False)) and not any(s < f and t < e for s, k, e in some if k >= 4 for t, j, f in base)
        marked = [(s, k, e, pii.votes(text, s, k, e)) for s, k, e in some]
        found.append(marked)
        votes.update(sum(v * 3**i for i, v in enumerate(x)) for *_, x in marked)
    patterns = np.array(sorted(votes), np.int64)
    _, post = pii.reliabilities(patterns, np.array([votes[p] for p in patterns.tolist()], float))
    soft = dict(zip(patterns.tolist(), post.tolist(), strict=True))
    xs, ys = [], []
    for text, marked in zip(texts, found, strict=True):
        for s, k, e, x in marked:
            xs.append(pii.hashed(text, s, k, e, x))
            ys.append(soft[sum(v * 3**i for i, v in enumerate(x))])
    model = pii.fit_spans(xs, np.array(ys))
    added = 0
    for k, (text, marked) in enumerate(zip(texts, found, strict=True)):
        want = sorted((s, kind, e) for s, kind, e, x in marked if kind < 4 or model.keeps(pii.hashed(text, s, kind, e, x)))
        assert got[k].spans == ",".join(f"{pii.KINDS[kind]}:{s}:{e}" for s, kind, e in want)
        added += sum(kind >= 4 for _, kind, _ in want)
    assert added and any("token = " + "aB3" * 90 in t for t in texts) and all("secret" not in r.spans or int(r.spans.split("secret:")[1].split(":")[1].split(",")[0]) > 0 for r in got.values())


def test_reliabilities():
    """A labeler that agrees with the majority gains weight, one at random does not."""
    rng = np.random.default_rng(0)
    truth = rng.random(5000) < 0.4
    vote = np.zeros((5000, pii.LABELERS), int)
    for i, right in enumerate((0.95, 0.9, 0.85, 0.5)):
        vote[:, i] = np.where(rng.random(5000) < right, truth, ~truth) * -1 + 2
    patterns, counts = np.unique((vote * 3 ** np.arange(pii.LABELERS)).sum(1), return_counts=True)
    table, post = pii.reliabilities(patterns, counts.astype(float))
    assert table[0, 1, 1] > 0.9 and table[0, 0, 2] > 0.9 and abs(table[3, 1, 1] - table[3, 0, 1]) < 0.1


# Language-model scores


def test_lm_base_scores(odd, empty):
    got = LM.lm_scores(odd, BYTE, public_tokenizers.PATTERN).collect()
    rows = [(i, [*words(t), "\0"], zlib.crc32(str(i if i is not None else "").encode()) % 10 == 0) for i, t, _ in ODD]
    counts = Counter(w for _, ws, held in rows for w in ws if not held)
    total, distinct = sum(counts.values()), len(counts)
    want = Counter((i, held, len(ws), sum(counts[w] > 0 for w in ws), total, round(sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in ws), 6)) for i, ws, held in rows)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got) and LM.lm_scores(empty, BYTE, public_tokenizers.PATTERN).count() == 0


def test_lm_sums_by_id():
    """The embedding's gradient comes from one sum for each id, frequent or absent, in the rows' own precision."""
    rng = np.random.default_rng(5)
    key, rows = np.minimum(rng.zipf(1.2, 3000), LM.INPUTS), rng.standard_normal((3000, LM.WIDTH))
    for kind, off in ((np.float64, 1e-9), (np.float32, 1e-3)):
        got, want = np.zeros((LM.INPUTS + 1, LM.WIDTH), kind), np.zeros((LM.INPUTS + 1, LM.WIDTH))
        LM._sum_by(key, rows.astype(kind), got)
        for k, row in zip(key.tolist(), rows, strict=True):
            want[k] += row
        assert got.dtype == kind and np.allclose(got, want, atol=off)


def test_lm_known_words_keep_their_ids(monkeypatch):
    """Words that come again, that are new, and that were forgotten all get the tokenizer's ids; known words stay in order."""
    monkeypatch.setattr(LM, "KEPT", 40)
    rng, code = np.random.default_rng(6), LM.Subwords(BYTE, public_tokenizers.PATTERN)
    for n in (0, 1, 30, 30, 5, 30, 30):
        text = " ".join(f"Word{k} x" for k in rng.integers(0, 60, n)).lower()
        data, off = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])
        starts, ends, _ = LM.words_of(data, off, LM.SPACE_WORDS) if n else (np.zeros(0, np.int64), np.zeros(0, np.int64), None)
        unique, at, which = np.unique(LM.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        ids, many = code.ids_of(text.encode(), starts, ends, unique, at, which)
        want = [code.code.encode_ordinary(" " + w) for w in text.split()]
        assert ids.tolist() == [i for x in want for i in x] and many.tolist() == [len(x) for x in want]
        assert (np.diff(code.known.astype(object)) > 0).all() and len(code.number) == len(code.known)


def random_targets(rng, rows):
    return rng.integers(0, LM.INPUTS, (rows, LM.LENGTH)), rng.integers(0, LM.GROUPS, (rows, LM.LENGTH)), rng.integers(0, LM.PLACES, (rows, LM.LENGTH))


def test_lm_gradient_and_masks():
    rng = np.random.default_rng(0)
    model = LM.AttentionModel(np.ones((LM.GROUPS, LM.PLACES)))
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    put, group, place = random_targets(rng, LM.BLOCK + 3)
    there = rng.random(put.shape) < 0.8
    loss, g = model.gradient(put, group, place, there)
    assert math.isclose(loss, -model.log_places(put, group, place)[there].mean(), rel_tol=1e-9)
    assert set(g) == set(model.p)
    for k in g:
        at = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        old, ends = model.p[k][at], []
        for step in (1e-5, -1e-5):
            model.p[k][at] = old + step
            ends.append(model.gradient(put, group, place, there)[0])
        model.p[k][at] = old
        assert math.isclose((ends[0] - ends[1]) / 2e-5, g[k][at], rel_tol=1e-3, abs_tol=1e-9), k
    later = put.copy()
    later[:, -1] = (later[:, -1] + 1) % LM.INPUTS  # the last input may change the last target only
    a, b = model.log_places(put, group, place), model.log_places(later, group, place)
    assert np.allclose(a[:, :-1], b[:, :-1]) and not np.allclose(a[:, -1], b[:, -1])
    q = LM.CONTEXT
    assert np.allclose(model.log_places(put, group[:, q:], place[:, q:], q), a[:, q:])


@pytest.mark.parametrize("step", [LM.LENGTH, LM.LENGTH - LM.CONTEXT])
def test_windows_have_each_id_as_target(step):
    ids, first = np.arange(100, 200).astype(np.uint16), np.array([0, 0, 1, 1 + LM.LENGTH, 100])
    found, row, k = LM.windows(ids, first, 7, step)
    for r in range(4):
        own = [7, *ids[first[r] : first[r + 1]].tolist(), 7]
        for w, n in zip(found[row == r], k[row == r], strict=True):
            want = own[n * step : n * step + LM.LENGTH + 1]
            assert w.tolist() == want + [LM.NOTHING] * (LM.LENGTH + 1 - len(want))
        mine = found[row == r]
        targets = [*mine[0, 1:], *(x for w in mine[1:] for x in w[1 + LM.LENGTH - step :])]
        assert [x for x in targets if x != LM.NOTHING] == own[1:]


def plain_log10(model, voc, ids, end):
    """log10 P of each id and the end, one at a time, from the window that scoring uses, without matrices of windows."""
    p, seq, step, out = model.p, [end, *ids, end], LM.LENGTH - LM.CONTEXT, []
    for t in range(1, len(seq)):
        begin = 0 if t <= LM.LENGTH else -(-(t - LM.LENGTH) // step) * step
        x = np.array([p["e"][voc.input[i]] for i in seq[begin:t]], np.float64)
        scores = np.array([x[-1] @ p["a"] @ x[j] + p["lag"][len(x) - 1 - j] for j in range(len(x))])
        share = np.exp(scores) / np.exp(scores).sum()
        h = x[-1] + (share @ x) @ p["b"] + (x[-2] @ p["c"] if len(x) > 1 else 0)
        h, log = np.append(h, 1), float(voc.share[seq[t]])
        for matrix, chosen in ((p["u"], voc.group[seq[t]]), (p["v"][voc.group[seq[t]]], voc.place[seq[t]])):
            z = h @ matrix
            log += z[chosen] - np.log(np.exp(z).sum())
        out.append(log / np.log(10))
    return out


def test_lm_scores_like_plain_loops():
    rng, code = np.random.default_rng(3), LM._subwords(BYTE, public_tokenizers.PATTERN)
    voc = LM.make_vocabulary(rng.integers(0, 50, code.size) ** 3.0, code.tokens)
    model = LM.AttentionModel(voc.mass)
    model.p = {k: (v + 0.3 * rng.standard_normal(v.shape)).astype(np.float32) for k, v in model.p.items()}
    first = np.cumsum([0, 0, 1, LM.LENGTH - 1, LM.LENGTH, LM.LENGTH + 1, 61, 5])
    ids = rng.integers(0, code.size, first[-1]).astype(np.uint16)
    got = LM.Scorer(model, voc, np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0).log10_ids(ids, first, code.end)
    want = [x for r in range(len(first) - 1) for x in plain_log10(model, voc, ids[first[r] : first[r + 1]].tolist(), code.end)]
    assert np.allclose(got, want, atol=1e-4)


def test_lm_probabilities_add_up():
    code = LM._subwords(BYTE, public_tokenizers.PATTERN)
    voc = LM.make_vocabulary(np.random.default_rng(1).integers(0, 9, code.size).astype(float), code.tokens)
    model = LM.AttentionModel(voc.mass)
    one = np.full((code.size, LM.LENGTH), LM.INPUTS)
    one[:, 0] = 5
    on = np.arange(code.size)
    log = np.concatenate([model.log_places(one[a : a + 4096], np.repeat(voc.group[on[a : a + 4096], None], LM.LENGTH, 1), np.repeat(voc.place[on[a : a + 4096], None], LM.LENGTH, 1))[:, 0] for a in range(0, code.size, 4096)])
    assert math.isclose(np.exp(log + voc.share[: code.size]).sum(), 1, rel_tol=1e-4)


def test_lm_learns(spark):
    text = " ".join(["red green blue"] * 30)
    docs = spark.createDataFrame([(k, text) for k in range(1500)], "doc_id long, text string").coalesce(1)  # the model sees each window once
    rows = LM.lm_scores(docs, BYTE, public_tokenizers.PATTERN).collect()
    assert all(r.score > 0.9 * r.base_score for r in rows)


def test_lm_tail_words_keep_their_share(spark, monkeypatch):
    """Scores don't change with the number of words that are broadcast."""
    docs = spark.createDataFrame([(k, f"red green blue word{k % 7} once{k}") for k in range(60)], "doc_id long, text string").repartition(2).cache()
    got = []
    for n in (1 << 19, 3):
        monkeypatch.setattr(LM, "HEAD_WORDS", n)
        got.append({r.doc_id: r.score for r in LM.lm_scores(docs, BYTE, public_tokenizers.PATTERN).collect()})
    assert all(math.isclose(got[0][k], got[1][k], abs_tol=1e-6) for k in range(60))


def test_lm_trains_on_all_documents(spark):
    code = LM._subwords(BYTE, public_tokenizers.PATTERN)
    rows = [(k % LM.PARTS, np.array(code.code.encode_ordinary(" red green blue" * (k % 40)), np.uint16).tobytes()) for k in range(300)]
    voc = LM.make_vocabulary(np.ones(code.size), code.tokens)
    model = LM.AttentionModel(voc.mass)
    ids = np.array(code.code.encode_ordinary(" red green blue" * 20), np.uint16)
    found, _, _ = LM.windows(ids, np.array([0, len(ids)]), code.end, LM.LENGTH)
    loss = lambda: model.gradient(voc.input[found[:, :-1]], voc.group[found[:, 1:]], voc.place[found[:, 1:]], found[:, 1:] != LM.NOTHING)[0]
    before = loss()
    seen = LM.train_on_all(spark.createDataFrame(rows, "part int, ids binary"), model, voc, code.end)
    assert seen == sum(1 + max(0, -(-(len(x) // 2 + 1 - LM.LENGTH) // LM.LENGTH)) for _, x in rows) and loss() < before


def test_lm_beats_the_base(spark):
    """Held-out texts of the test tables are likelier than under smoothed word counts."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    r = LM.lm_scores(docs, BYTE, public_tokenizers.PATTERN).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_frequent_words(spark):
    words = spark.createDataFrame([(k, 1 + k // 10) for k in range(1000)], "h long, c long")
    for most in (0, 5, 50, 999, 1000):
        got = [r.c for r in LM.frequent(words, most).collect()]
        assert len(got) <= most and (most < 50 or len(got) > most / 4) and (not got or len(got) == sum(1 + k // 10 >= min(got) for k in range(1000)))


# HTML


def test_rendering():
    html = """<html><head><title>T &amp; x</title><style>p{}</style></head><body><h1>Hi</h1><p>one <b>two</b>
 three<br>four<p>five<ul><li>a<li>b<ol start=3><li>x<p>y</ol><li>c</ul>tail<table><tr><th>name<th>n<tr><td>alpha<td>1<tr><td>b<td>22</table>
<div style='display: none'>no</div><span hidden>no</span><pre>
 a
   b
</pre><dl><dt>t<dd>d</dl><script>var x='</p>'</script>end &copy; &amp"""
    title, text = page_text(html)
    assert title == "T & x"
    assert text == "Hi\n\none two three\nfour\n\nfive\n\n- a\n- b\n\n  3. x\n\n     y\n- c\n\ntail\n\nname   n\nalpha  1\nb      22\n\n a\n   b\n\nt\n  d\n\nend © &"
    assert page_text(None) == (None, "") and page_text("<div>" * 3000 + "x")[1] == "x" and page_text("<table><td>漢<td>b<tr><td>a<td>c</table>")[1] == "漢  b\na   c"


@pytest.mark.parametrize(("html", "text"), [
    ("<div><li>x", "- x"), ("<li>x<li>y", "- x\n- y"), ("<ul><div><li>x</div><li>y</ul>", "- x\n- y"), ("<div><td>x", "x"), ("<div><tr><td>a<td>b<tr><td>cc<td>d</div>e", "a   b\ncc  d\ne"),
    ("<table><form><tr><td>a<td>b</form></table>", "a  b"), ("<ul><td>x</td><tr><td>y</ul>", "x\ny"), ("<div><li></div>x", "x"),
    ("<head><title>t</title><p>text", "text"), ("<head><title>t</title>text", "text"), ("<head><meta charset=x><style>p{}</style>\n<body>text", "text"),
    ("<table><tr>s<b>t</b><td>a</table>", "st\na"), ("<table><tbody>s<tr><td>a</table>", "s\na"), ("<table><b><td>a<td>b</table>", "a  b"), ("<table><tr><div>s</div><td>a</table>", "s\na"),
    ("<textarea>\na\nb</textarea>", "a\nb"), ("<select><option>a<option selected>b</select> c", "b c"), ("<select><option disabled>a<option>b</select>", "b"), ("<select multiple><optgroup><option>a<option>b</select>", "a\nb"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"), ("<div style='visibility:hidden'>no<p style='visibility: visible'>yes</p>no</div>z", "yes\nz"), ("<div style=display:none>no<p style='visibility:visible'>no</div>z", "z"),
    ("<p title='a>b'>x</p><img alt='q'>a < b &amp; c<!-- d --><!-->e<?f><!g></>", "x\n\na < b & ce"), ("x<!-- y", "x"), ("x<a href='y>z", "x"), ("<table><tr><td>" + "z" * 500 + "<td>c<tr><td>a<td>b</table>", "z" * 500 + "  c\na" + " " * 2 + "b"),
    ("<input value=x><input type=hidden value=y><input type=submit value=z><button>w</button>", "xzw"), ("<textarea hidden>a</textarea>", ""),
])
def test_untidy_pages(html, text):
    assert page_text(html)[1] == text


def test_broken_markup_never_fails_and_keeps_words():
    """Random tags: each word outside titles, options and their like is there once, and outside tables in the same order."""
    rng, tags = np.random.default_rng(0), "div p li ul ol td tr table tbody form pre b h2 body dd dt q caption br span blockquote section".split()
    for k in range(10_000):
        parts, words = [], []
        for i in range(12):
            parts.append(f"{rng.choice(['<', '</'])}{rng.choice(tags if k % 2 else [t for t in tags if t not in ('table', 'caption', 'tbody', 'tr', 'td')])}>")
            if rng.random() < 0.5:
                words.append(f"w{i}")
                parts.append(words[-1])
        found = re.findall(r"w[0-9]+", page_text("".join(parts))[1])
        assert (found == words) if not k % 2 else sorted(found) == sorted(words), "".join(parts)
    odd = "div p head title body select option textarea table td input script hr".split()
    for _ in range(3000):
        page_text("".join(f"{rng.choice(['<', '</'])}{rng.choice(odd)}>{rng.choice(['', 'x', ' '])}" for _ in range(12)))


@pytest.mark.parametrize("html", ["<!--" * 20_000, "<a " * 20_000, '<a b="' * 20_000, "<ul><li>" * 10_000 + "x", "<blockquote>" * 4000 + "x<br>" * 4000, "<" * 100_000, "<script>" * 20_000, "<table>" + "<td colspan=1000>x" * 5000, "<table>" + "<td rowspan=60000>x<tr>" * 4000, "<table>" + "<tr><td>a<td>b" * 2000 + "<tr><td>" + "z" * 100_000])
def test_hard_pages_stay_small(html):
    assert len(page_text(html)[1]) < 20 * len(html) + 1000


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a"), (None, None, None), (2, "u", ""), (2, "u", "<p>a")], "page_id long, url string, html string").withColumn("text", F.lit("x"))
    assert Counter((r.page_id, r.title, r.text, r.n_chars) for r in extract_text(pages).collect()) == Counter([(1, None, "a", 1), (None, None, "", 0), (2, None, "", 0), (2, None, "a", 1)])
    assert extract_text(pages.limit(0)).count() == 0


def test_all_queries_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 14)]
    assert json.dumps(sorted(ORACLES)) and pa.array([1])


def test_no_break_spaces_are_words():
    """Words that the vocabulary would join over a space are encoded apart."""
    code = LM._subwords(BYTE, public_tokenizers.PATTERN)
    for text in ("\xa0 \xa0\xa0 x y z \xa0\xa0\xa0\xa0", "a \xa0 b \xa0\xa0 \xa0\xa0\xa0 \xa0\xa0\xa0\xa0\xa0 c d e f", " ".join("\xa0" * k for k in range(1, 60))):
        code._forget()
        for _, _, data, off in text_chunks(pa.array([text])):
            starts, ends, _ = words_of(data, off, SPACE_WORDS)
            unique, at, which = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
            ids, n = code.ids_of(data.tobytes(), starts, ends, unique, at, which)
            apart = [code.code.encode_ordinary(" " + w) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
            assert ids.tolist() == [i for x in apart for i in x] and n.tolist() == [len(x) for x in apart]


def test_a_phrase_of_many_items_is_no_hot_key(spark):
    """Items that share eight words: each candidate of a document meets the one window that it holds."""
    phrase = "one two three four five six seven eight"
    items = spark.createDataFrame([(k, f"a{k} {phrase} b{k} c{k}") for k in range(3000)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x a7 {phrase} b7 y"), (2, f"x {phrase} y z"), (3, f"a7 {phrase} b8"), (4, f"{phrase} b9 c9 tail")], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items) for r in contamination(docs, items).collect()}
    assert got == {1: (10, 1), 2: (0, 0), 3: (0, 0), 4: (10, 1)}


def plain_lines(node):
    """A second renderer, for well-formed trees of a few tags: text by recursion, each block's lines made anew."""
    tag, kids = node
    out, run, gap = [], [], False
    if tag == "closed":  # a block without lines
        return out

    def put(lines, spaced):
        nonlocal gap
        if lines:
            out.extend([""] if out and (gap or spaced) else [])
            out.extend(lines)
            gap = spaced

    def flush():
        text = "".join(run)
        run.clear()
        if text.strip():
            cut = [re.sub(r"\s+", " ", x).strip() for x in text.split("\0")]
            put(cut[:-1] if cut[-1] == "" else cut, False)

    def inline(x):
        if isinstance(x, str):
            return [x]
        if x[0] == "br":
            return ["\0"]
        if x[0] in ("hidden", "template"):
            return []
        return [y for k in x[1] for y in inline(k)] if x[0] in ("b", "span", "a") else [x]

    items = [y for k in kids for y in inline(k)]
    if tag == "table":
        rows = [[plain_lines(("cell", cell[1])) for cell in row[1]] for row in kids]
        wide = [max([0, *(len(line) for row in rows if c < len(row) for line in row[c] if len(line) <= 120)]) for c in range(max(map(len, rows), default=0))]
        for row in rows:
            for k in range(max(map(len, row), default=0)):
                line = ""
                for c, cell in enumerate(row):
                    if k < len(cell) and cell[k]:
                        line += " " * max(sum(wide[:c]) + 2 * c - len(line), 2 if line else 0) + cell[k]
                out.append(line)
        return out
    if tag in ("ul", "ol"):
        for n, item in enumerate(kids):
            mark = "- " if tag == "ul" else f"{n + 1}. "
            lines = plain_lines(item)
            out.extend([mark + lines[0], *(" " * len(mark) + x if x else x for x in lines[1:])] if lines else [])
        return out
    for item in items:
        if isinstance(item, str):
            run.append(item)
        else:
            flush()
            put(plain_lines(item), item[0] in ("p", "h1", "ul", "ol", "table"))
    flush()
    return out


def random_tree(rng, depth, inline=False):
    def text():
        return " ".join(rng.choice(["word", "two\n lines", "x", "long-word-here", "ä"]) for _ in range(rng.randint(0, 4))) + rng.choice(["", " "])

    def kids(inline, most=4):
        out = []
        for _ in range(rng.randint(0, most)):
            kind = rng.random()
            out.append(text() if kind < 0.4 or depth == 0 else ("br", []) if kind < 0.46 else random_tree(rng, depth - 1, inline))
        return out

    tags = ["b", "span", "a", "hidden", "template"] + ([] if inline else ["div", "p", "h1", "ul", "ol", "table", "section", "closed"] * 2)
    tag = rng.choice(tags)
    if tag in ("ul", "ol"):
        return tag, [("li", kids(False)) for _ in range(rng.randint(0, 3))]
    if tag == "table":
        return tag, [("tr", [("td", kids(True)) for _ in range(rng.randint(0, 3))]) for _ in range(rng.randint(0, 3))]
    return tag, kids(inline or tag in ("b", "span", "a", "p", "h1"))


def markup(node):
    if isinstance(node, str):
        return node
    tag, inside = node[0], "".join(map(markup, node[1]))
    return {"br": "<br>", "hidden": f'<b class="h {len(inside)}">{inside}</b>', "closed": f"<details>{inside}</details>"}.get(tag, f"<{tag}>{inside}</{tag}>")


def test_html_equals_a_plain_renderer():
    import random

    rng = random.Random(11)
    for _ in range(2000):
        tree = ("div", [random_tree(rng, 4) for _ in range(3)])
        page = "<style>.h{display:none}</style>" + markup(tree)
        assert page_text(page)[1] == "\n".join(plain_lines(tree)), page


@pytest.mark.parametrize("unit", ["<table><tr><td>a", "<div>a", "<li>a", "<b>a", "<ul><li>a"])
def test_html_is_linear_on_nested_pages(unit):
    for page in ((unit * (1_000_000 // len(unit))), "<h1><div>" + "<b>" * 100_000 + "<h2>x</h2>" * 60_000, "<p><button>" + "<div>" * 180_000):
        start = time.process_time()
        text = page_text(page)[1]
        assert time.process_time() - start < 20  # seconds; a pass that is quadratic takes hours
        assert text.count("a") == (len(page) // len(unit) if page.startswith(unit) else 0)


def test_html_shows_drawings_and_follows_rules_of_the_page():
    show = lambda html: page_text(html)[1]
    assert show("<svg><title>no</title><text>s</text><text>t</text></svg><math><mi>x</mi></math>") == "s\nt\nx" and page_text("<svg><title>no</title></svg><title>yes</title>")[0] == "yes"
    assert show("<details><summary>S</summary>no<p>no</p></details>after<details open><summary>T</summary>shown</details>") == "S\nafter\nT\nshown"
    rules = "<style>/* .c{display:none} */ .h, .g{display:none} @media print{.k{display:none}} #z , em{visibility:hidden} .g{display:block}</style>"
    assert show(rules + "<p class='a h'>no</p><p class=k>1</p><i id=z>no</i><em>no</em><p class=g>2</p><p class=c>3</p><p class=h style='display:block'>4</p>") == "1\n\n2\n\n3\n\n4"
    assert show("<select multiple><optgroup label=G><option>a<option>b</optgroup></select><select><optgroup label=G><option>c</select>") == "G\na\nbc"


def test_toxicity_fit_equals_dense_gradient_descent(monkeypatch):
    """The fit over blocks of present buckets is plain gradient descent on the dense matrix of ratios, at any block size."""
    rng = np.random.default_rng(8)
    keep = rng.random(60) < 0.5
    ratios, kept = rng.normal(size=60), np.flatnonzero(keep)
    rows = [np.sort(rng.choice(kept, rng.integers(0, 9), replace=False)).astype(np.int32) for _ in range(80)]
    y = (rng.random(80) < 0.4).astype(float)
    x = np.zeros((80, len(kept)))
    for k, r in enumerate(rows):
        x[k, np.searchsorted(kept, r)] = ratios[r]
    w, b, v, vb = np.zeros(len(kept)), math.log((y.sum() + 1) / (80 - y.sum() + 1)), np.zeros(len(kept)), 0.0
    spread, losses = np.sqrt((x * x).mean(0)) + 1e-6, []
    for _ in range(toxicity.STEPS):
        z = x @ w + b
        losses.append(np.mean(np.logaddexp(0, z) - y * z) + toxicity.RIDGE / 2 * (w * w * spread).sum())
        if len(losses) > toxicity.PATIENCE and losses[-1 - toxicity.PATIENCE] - losses[-1] < toxicity.SMALL * losses[0]:
            break
        e = 1 / (1 + np.exp(-z)) - y
        v = 0.9 * v - 0.1 * toxicity.RATE * (x.T @ e / 80 / spread + toxicity.RIDGE * w)
        vb = 0.9 * vb - 0.1 * toxicity.RATE * e.mean()
        w, b = w + v, b + vb
    for block in (1 << 20, 40):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        got = toxicity.fit_presence(np.searchsorted(kept, np.concatenate(rows)), np.array([len(r) for r in rows]), y, ratios, keep)
        assert np.allclose(got.weights[kept], w * ratios[kept], rtol=1e-6, atol=1e-7) and abs(got.bias - b) < 1e-9 and not got.weights[~keep].any()
    assert toxicity.fit_presence(np.zeros(0, np.int32), np.zeros(0, int), np.zeros(0), ratios, keep).weights.shape == (60,)


def test_token_counts_of_every_character(spark):
    """Every code point of planes 0 to 3, beside letters and digits: also those younger than Python's tables."""
    from tokenizers import Tokenizer

    points = [p for p in range(1, 0x40000) if not 0xD800 <= p < 0xE000]
    texts = [f"a{chr(p)}b 1{chr(p)}" for p in points]
    found = token_counts.count_texts(texts, token_counts.WordBpe(BPE))
    library = Tokenizer.from_file(BPE).encode_batch(texts, add_special_tokens=False)
    assert [hex(p) for p, a, b in zip(points, found.tolist(), library, strict=True) if a != len(b.ids)] == []


def plain_quality_features(text):
    """The features by loops over bytes and words."""
    data = (text or "").encode()
    n, kinds = len(data), [int(quality._CLASS[b]) for b in data]
    ones = [kinds.count(k) for k in range(quality.CLASSES)]
    pairs = Counter(zip(kinds, kinds[1:]))  # noqa: B905, RUF007
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    w, many = len(words), Counter(x.lower() for x in words)
    share = lambda values: sum(values) / max(w, 1)
    mean = share(len(x) for x in words)
    extra = [
        math.log1p(n), math.log1p(w), mean / 10, math.sqrt(max(share(len(x) ** 2 for x in words) - mean**2, 0)) / 10, len(many) / max(w, 1), max(many.values(), default=0) / max(w, 1), share(quality._CLASS[x[-1]] >= 7 for x in words),
        share(quality._CLASS[x[0]] == 1 for x in words), math.log1p(w / max(ones[4] + (n > 0), 1)), share(len(x) <= 3 for x in words),
    ]
    return [*(v / max(n, 1) for v in ones), *(pairs[i, j] / max(n, 1) for i in range(quality.CLASSES) for j in range(quality.CLASSES)), *extra]


def test_quality_features_equal_loops(spark):
    texts = [t for _, t, _ in ODD] + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()] + ["A|b\r\nC  d!?", "\n\n", "x", "Ünï 12%"]
    got = quality.features(pa.array(texts, pa.string()))
    assert got.shape == (len(texts), quality.FEATURES)
    for row, text in zip(got, texts, strict=True):
        assert np.allclose(row, plain_quality_features(text), rtol=1e-5, atol=1e-6), text and text[:80]
    assert quality.features(pa.array(texts, pa.string()).slice(3, 5)).tolist() == got[3:8].tolist()

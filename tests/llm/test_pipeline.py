"""The pipeline on a small table: each stage against a plain version of it on the stage's own input."""

import re
import string
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as P
from test_operators import brute_targets

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """(name, input rows, output) of every stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in P.STAGES:
        after = P.materialise(stage(spark, docs, SF), f"test-{name}")
        out.append((name, docs.toPandas(), after))
        docs = after
    return {n: (a, b.toPandas(), b.columns) for n, a, b in out}


def test_columns(kept):
    for name, (_, _, columns) in kept.items():
        assert columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and (len(columns) == 5 or name == "mix")


def test_quality_keeps_good(spark, kept):
    before, after, _ = kept["quality"]
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id").quality
    known = before[before.doc_id.isin(labels.index)]
    right = np.mean([(i in set(after.doc_id)) == (labels[i] == 1) for i in known.doc_id])
    assert right > 0.9 and 0 < len(after) < len(before)


def test_exact(kept):
    before, after, _ = kept["exact_dedup"]
    best = before.assign(k=before.text.fillna("").str.translate(LOWER)).groupby("k").doc_id.max()
    assert sorted(after.doc_id) == sorted(best)


def test_near(kept):
    before, after, _ = kept["near_dedup"]
    sets = {}
    for i, t in zip(before.doc_id, before.text, strict=True):
        ws = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(ws[a : a + 5]) for a in range(max(len(ws) - 4, 1))} if ws else set()
    links = [(a, b) for a in sets for b in sets if a < b and (c := len(sets[a] & sets[b])) and 100 * c >= 75 * len(sets[a] | sets[b])]
    label = {i: i for i in sets}
    for _ in sets:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert sorted(after.doc_id) == sorted({label[i] for i in sets})


def test_benchmark(spark, kept):
    before, after, _ = kept["decontaminate"]
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = set()
    for t in spark.read.parquet(f"{SF}/benchmark.parquet").toPandas().text:
        ws = re.findall(pattern, t.translate(LOWER))
        windows |= {tuple(ws[a : a + 10]) for a in range(max(len(ws) - 9, 1))}
    sizes = {len(w) for w in windows}
    hit = lambda ws: any(tuple(ws[a : a + n]) in windows for n in sizes for a in range(len(ws) - n + 1))
    assert sorted(after.doc_id) == sorted(i for i, t in zip(before.doc_id, before.text, strict=True) if not hit(re.findall(pattern, (t or "").translate(LOWER))))


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mix(kept):
    """Each source's words end within half of its largest document of the target; no row is taken more than twice."""
    before, after, _ = kept["mix"]
    assert set(after.doc_id) <= set(before.doc_id) and max(Counter(after.doc_id).values()) <= 2
    assert sorted(set(after.mix_copy)) in ([1], [1, 2])
    before, after = before.assign(size=before.text.map(words)), after.assign(size=after.text.map(words))
    sizes = before.groupby("source")["size"].sum().to_dict()
    targets, taken = brute_targets(sizes), after.groupby("source")["size"].sum().to_dict()
    for source, target in targets.items():
        assert abs(taken.get(source, 0) - target) <= before[before.source == source]["size"].max() / 2 + 1e-6


def test_stages_on_odd_and_empty_tables(spark):
    """Nulls, empty texts, repeated rows and columns with clashing names go through every stage."""
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (2, text.upper(), None, None), (None, None, None, None), (3, None, "en", "a"), (4, "", "en", "b"), (5, text + " more", "en", "b"), (None, "left alone", "en", "b"), (6, "kept words here", "en", None)]
    names = ("rid", "h", "r", "key", "row", "mine", "again", "sha", "best", "component_id", "text_hash", "sk", "mix_copy", "range")
    docs = spark.createDataFrame([(*r, 0, *("x" for _ in names)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)).repartition(3)
    for start in (docs, docs.limit(0)):
        kept = start
        for name, stage in P.STAGES:
            before, kept = kept, P.materialise(stage(spark, kept, SF), f"odd-{name}")
            assert kept.columns == [*docs.columns, *(["mix_copy_"] if name == "mix" else [])]
            assert name == "mix" or kept.exceptAll(before).count() == 0
        assert start is docs or kept.count() == 0
    exact = P.exact(spark, docs, SF)
    assert Counter((r.text or "").translate(LOWER) for r in exact.collect()) == Counter({(r[1] or "").translate(LOWER) for r in rows})
    near = P.near(spark, exact, SF).collect()
    assert sorted(r.doc_id for r in near if r.text and r.text.lower().startswith("one two")) == [2]


def test_run(spark, kept):
    assert sorted(r.doc_id for r in P.run(spark, SF).select("doc_id").collect()) == sorted(kept["mix"][1].doc_id)

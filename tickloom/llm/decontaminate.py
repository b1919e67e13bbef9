"""Benchmark decontamination by winnowing.

Of the K-grams of each window of WINDOW words the one with the least hash is kept (the last of equals), so equal
windows keep the same K-gram wherever they stand, and every shared span of WINDOW words shares a kept one.  The hashes of
kept K-grams are the fingerprints.  Those of the benchmark also fill a fixed-size bit set, so document fingerprints that
it lacks are dropped where they are read.  The others are joined with the benchmark's by fingerprint, and a hit is
extended: the words on both sides of the K-gram are compared, and the spans of WINDOW words or more that agree are united.
Items of fewer than WINDOW words are their own fingerprint, one for each length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .buckets import BitSet, bucket_counts
from .common import ALNUM_WORDS, drop_rows, gram_hashes, materialise, starts_within, text_chunks, word_hashes, words_of

WINDOW, K = 10, 8
#: Bits of the benchmark's filter by window, and its bounds (2**27 bits are 16 MB).
BITS_A_WINDOW = 32
LOG2_LEAST, LOG2_MOST = 16, 27
#: The benchmark's distinct windows (some 100 bytes each) are broadcast up to this number, else joined by shuffle.
BROADCAST_WINDOWS = 200_000
#: Words on each side of a K-gram that a window with it may have, and bytes of a word's hash.
SIDE, WORD_BYTES = WINDOW - K, 8

_WINDOWS = "item_id string, n int, fp long, place int, w binary"
_CANDIDATES = "rid long, doc_id {id}, text_hash long, n_words long, found array<struct<at:int,n:int,fp:long,around:binary>>"


def window_prints(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, place of the kept K-gram in it, fingerprint) of every window of WINDOW words inside a row."""
    at, _ = starts_within(first, WINDOW)
    grams = gram_hashes(words, K)
    best, place = grams[at], np.zeros(len(at), np.int64)
    for j in range(1, SIDE + 1):
        other = grams[at + j]
        place[other <= best] = j
        best = np.minimum(best, other)
    return at, place, best


def kept_prints(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, fingerprint) of the K-grams that some window of the row keeps, each once."""
    at, place, print_ = window_prints(words, first)
    kept = at + place
    new = np.append(True, kept[1:] != kept[:-1])[: len(kept)]  # kept K-grams never go back
    return kept[new], print_[new]


def short_prints(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every run of n < WINDOW words inside a row."""
    at, _ = starts_within(first, n)
    return at, gram_hashes(words, n)[at] ^ np.uint64(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1)


def _words_at(words: np.ndarray, at: np.ndarray, n: int) -> pa.Array:
    """The hashes of words at..at+n-1 as bytes, zero past either end of `words`."""
    padded = np.concatenate([np.zeros(SIDE, np.uint64), words, np.zeros(n, np.uint64)])
    raw = padded[(at + SIDE)[:, None] + np.arange(n)].tobytes()
    size = n * WORD_BYTES
    return pa.array([raw[k : k + size] for k in range(0, len(raw), size)], pa.binary())


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for a, b, data, off in text_chunks(batch.column(1)):
            starts, ends, first = words_of(data, off, ALNUM_WORDS)
            h, counts = word_hashes(data, starts, ends), np.diff(first)
            found = [(WINDOW, *window_prints(h, first))]
            for n in sorted({int(c) for c in counts if 0 < c < WINDOW}):
                at, fp = short_prints(h, first, n)
                on = counts[np.searchsorted(first, at, "right") - 1] == n
                found.append((n, at[on], np.zeros(on.sum(), np.int64), fp[on]))
            for n, at, place, fp in found:
                row = np.searchsorted(first, at, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a).take(pa.array(row)), pa.array(np.full(len(at), n), pa.int32()), pa.array(fp.view(np.int64)), pa.array(place, pa.int32()), _words_at(h, at, n)], ["item_id", "n", "fp", "place", "w"]
                )


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, n, fp, place, w): the windows of each item with their kept K-gram; one of fewer words is one window, one without words has none."""
    return items.select(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`")).mapInArrow(_item_windows, _WINDOWS).distinct()


def _candidates(bits, lengths: list[int]):
    """Per document: its words and the fingerprints that the benchmark may have, with the words around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in text_chunks(batch.column(3)):
                starts, ends, first = words_of(data, off, ALNUM_WORDS)
                h = word_hashes(data, starts, ends)
                where, sizes, prints = [], [], []
                for n, (at, fp) in [(WINDOW, kept_prints(h, first)), *((n, short_prints(h, first, n)) for n in lengths)]:
                    on = bits.value.has(fp)
                    where.append(at[on])
                    prints.append(fp[on])
                    sizes.append(np.full(on.sum(), n))
                where, sizes, prints = (np.concatenate(x) for x in (where, sizes, prints))
                order = np.argsort(where, kind="stable")
                where, sizes, prints = where[order], sizes[order], prints[order]
                cuts = np.searchsorted(where, first).astype(np.int32)
                local = where - first[np.searchsorted(first, where, "right") - 1]
                found = pa.StructArray.from_arrays([pa.array(local, pa.int32()), pa.array(sizes, pa.int32()), pa.array(prints.view(np.int64)), _words_at(h, where - SIDE, 2 * SIDE + K)], ["at", "n", "fp", "around"])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(a, b - a) for i in range(3)), pa.array(np.diff(first), pa.int64()), pa.ListArray.from_arrays(pa.array(cuts), found)], ["rid", "doc_id", "text_hash", "n_words", "found"]
                )

    return run


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: rid, doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated.

    Words are runs of ASCII letters and digits and non-ASCII characters, A-Z in lower case.  A word is hit if any
    occurrence of a benchmark window covers it.  Null or empty texts have no words and no hits; rows of one id are
    told apart by `rid`; items of one id count once; items with a null id hit but are not listed; an empty benchmark
    hits nothing.  Words are compared by 64-bit hashes, all of a window's.  Other columns are not read.
    """
    spark = docs.sparkSession
    windows = materialise(benchmark_windows(items, item_id_col, item_text_col), "windows")
    size = windows.count()
    lengths = sorted(r["n"] for r in windows.filter(F.col("n") < WINDOW).select("n").distinct().collect())
    log2 = min(LOG2_MOST, max(LOG2_LEAST, (BITS_A_WINDOW * max(size, 1) - 1).bit_length()))
    mask = (1 << log2) - 1
    prints = bucket_counts(windows.select("fp"), lambda batch: [batch.column(0).to_numpy(zero_copy_only=False) & mask], log2, top=1)
    bits = spark.sparkContext.broadcast(BitSet(prints > 0))

    named = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash"), F.col(f"`{text_col}`").alias("text"))
    rows = materialise(named.mapInArrow(_candidates(bits, lengths), _CANDIDATES.format(id=named.schema["doc_id"].dataType.simpleString())), "candidates")

    # Hits by fingerprint, extended: each place that the K-gram may have in a window gives the words that such a window would
    # have around it, and the join is on fingerprint, place and those words, so that a phrase of many items is no hot key: a
    # candidate meets one window at most.
    keys = windows.select("n", "fp", "place", "w", F.xxhash64("w").alias("wh")).distinct()
    hits = rows.filter(F.size("found") > 0).select("rid", "n_words", F.explode("found").alias("f")).select("rid", "n_words", "f.*")
    hits = hits.withColumn("place", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - K, F.lit(0)))))
    hits = hits.filter((F.col("at") >= F.col("place")) & (F.col("at") - F.col("place") + F.col("n") <= F.col("n_words")))
    hits = hits.withColumn("w", F.substring("around", (SIDE - F.col("place")) * WORD_BYTES + 1, F.col("n") * WORD_BYTES)).withColumn("wh", F.xxhash64("w")).drop("around")
    hits = hits.join(F.broadcast(keys) if size <= BROADCAST_WINDOWS else keys, ["n", "fp", "place", "wh", "w"])
    hits = hits.select("rid", (F.col("at") - F.col("place")).alias("at"), (F.col("at") - F.col("place") + F.col("n")).alias("end"), F.md5("w").alias("w"))
    before = Window.partitionBy("rid").orderBy("at", "end").rowsBetween(Window.unboundedPreceding, -1)
    hits = hits.withColumn("fresh", F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("at"), F.coalesce(F.max("end").over(before), F.lit(0)))))
    by_doc = hits.groupBy("rid").agg(F.sum("fresh").alias("n_hit"), F.array_sort(F.collect_set("w")).alias("ws"))
    by_doc = materialise(by_doc.withColumn("set", F.md5(F.concat_ws("", "ws").cast("binary"))), "hits")

    # Documents with the same windows (copies of a passage) have the same items: those are looked up once a set.
    sets = by_doc.groupBy("set").agg(F.first("ws").alias("ws")).select("set", F.explode("ws").alias("w"))
    listed = sets.join(windows.select(F.md5("w").alias("w"), "item_id").distinct(), "w").groupBy("set").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    listed = listed.select("set", F.size("ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "ids").cast("binary"), 256).alias("items_sha256"))
    found = by_doc.select("rid", "n_hit", "set").join(listed, "set", "left")
    zero, none = F.lit(0).cast("long"), F.lit(hashlib.sha256(b"").hexdigest())
    return rows.select("rid", "doc_id", "text_hash", "n_words").join(found, "rid", "left").select(
        "rid", "doc_id", "text_hash", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), (F.coalesce("n_hit", zero) > 0).alias("contaminated")
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, whole, that no benchmark window touches; rows of one id and text share the decision.

    Rows with null or empty texts stay; column names of `docs` may be any.
    """
    bad = contamination(docs, items, id_col, text_col).filter("contaminated").select("doc_id", "text_hash").distinct()
    return drop_rows(docs, materialise(bad, "contaminated"), id_col, text_col)

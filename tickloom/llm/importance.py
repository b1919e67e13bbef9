"""Importance resampling towards a target distribution by hashed n-grams.

One scan of each document keeps the running CRC-32 states of the last n starts in a ring: each new word extends them by a
space and itself and begins a state of its own, and every state gives the bucket of one feature.  Buckets are written once to
the shared folder; counts of all documents and targets by bucket, and the documents' weights, come from them.  Scores are
whole numbers, so the draw needs only counts by score up to a threshold and the places of the drawn rows among equal scores.

Null and empty texts have no words: no features, weight 0.  Repeated rows are documents of their own and take ranks one after
another.  An empty table gives no rows, an empty target counts as one without features.  Long texts are scanned in pieces of a
bounded size, cut between words.  A null id scores as the empty string does and comes last among ties.  Only the id and text
columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ALNUM_WORDS, materialise

#: Longest run of words of a feature, buckets, fewest words of a document that may be drawn, percent drawn, seed.
RUN, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: Bytes of a text scanned at a time.
PIECE = 1 << 20
_SPLIT = bytes(c + 32 if 65 <= c <= 90 else c if ALNUM_WORDS[c] else 32 for c in range(256))


def pieces(text: bytes, limit: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, in lists of about `limit` bytes."""
    text, a = text.translate(_SPLIT), 0
    while a < len(text):
        b = len(text) if len(text) - a <= limit else text.find(b" ", a + limit)
        b = len(text) if b < 0 else b
        yield text[a:b].split()
        a = b


def feature_hashes(text: bytes, n: int = RUN) -> Iterator[list[int]]:
    """CRC-32 of every run of 1 to n words joined by one space, in lists; the ring holds the states of the last n - 1 starts."""
    ring: list[int] = []
    for words in pieces(text):
        if n == 1:
            yield [zlib.crc32(w) for w in words]
            continue
        out: list[int] = []
        for word in words:
            spaced = b" " + word
            ring = [zlib.crc32(spaced, state) for state in ring]
            ring.append(zlib.crc32(word))
            out += ring
            if len(ring) == n:
                del ring[0]
        yield out


def feature_buckets(docs: DataFrame, id_col: str, text_col: str, n: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, features): the buckets of each document as packed numbers of 4 bytes."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed, sizes = [], []
            for text in batch.column(1):
                found = [np.array(h, np.uint32) % np.uint32(buckets) for h in feature_hashes(text.as_py() or b"", n)]
                every = np.concatenate(found) if found else np.zeros(0, np.uint32)
                packed.append(every.astype("<u4").tobytes())
                # Of w words there are w + (w - 1) + ... runs; w follows from their number.
                sizes.append(_words_of_runs(len(every), n))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_words": pa.array(sizes, pa.int64()), "features": pa.array(packed, pa.binary())})

    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, features binary")


def _words_of_runs(runs: int, n: int) -> int:
    """The number of words that have so many runs of 1 to n words."""
    w = 0
    while w < n and runs > 0:
        w += 1
        runs -= w
    return w + runs // n


def bucket_totals(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features by bucket over all rows; one number a bucket is gathered."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros(buckets, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                have += np.bincount(np.frombuffer(packed.as_py(), "<u4"), minlength=buckets)
        at = np.flatnonzero(have)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int64()), "n": pa.array(have[at])})

    totals = np.zeros(buckets, np.int64)
    for row in found.select("features").mapInArrow(local, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        totals[row["bucket"]] = row["n"]
    return totals


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of smoothed shares of the target and of all documents, by bucket."""
    s_all, t_all, k = int(source.sum()), int(target.sum()), len(source)
    ratio = (target + 1.0) * (s_all + k) / ((source + 1.0) * (t_all + k))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean of the gains of a document's features."""
    kind = found.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, weight = [], []
            for packed in batch.column(2):
                features = np.frombuffer(packed.as_py(), "<u4")
                n.append(len(features))
                weight.append(int(gain[features].sum()) // len(features) if len(features) else 0)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_words": batch.column(1), "n_features": pa.array(n, pa.int64()), "weight": pa.array(weight, pa.int64())})

    return found.select("doc_id", "n_words", "features").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id, seed: int = SEED):
    """floor(1000 g), g a Gumbel variate that the id decides."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(scored: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """`scored` with rank: 1, 2, ... of the drawn share of rows with `least` words, by falling score and rising doc_id.

    Scores are whole numbers of a bounded range, so counts by score are a bounded table; it gives the lowest score drawn
    and how many rows rank before each score.  Only drawn rows are ordered, those of each score by themselves.
    """
    able = F.col("n_words") >= least
    counts = scored.filter(able).groupBy("score").agg(F.count(F.lit(1)).alias("here"))
    upto = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.lit(1))
    counts = counts.withColumns({"_before": F.sum("here").over(upto) - F.col("here"), "_draw": F.floor(F.sum("here").over(whole) * percent / 100).cast("long")})
    counts = counts.filter(F.col("_before") < F.col("_draw")).select(F.col("score").alias("_score"), "_before", "_draw")
    rows = scored.join(F.broadcast(counts), able & (F.col("score") == F.col("_score")), "left")
    # Rows that are not drawn need no order: they stay apart and are not shuffled.
    place = F.col("_before") + F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last()))
    names = [c for c in scored.columns if c != "n_words"]
    drawn = rows.filter("_before is not null").withColumn("rank", place).select(*names, "n_words", F.when(F.col("rank") <= F.col("_draw"), F.col("rank")).cast("long").alias("rank"))
    return drawn.unionByName(rows.filter("_before is null").select(*names, "n_words", F.lit(None).cast("long").alias("rank")))


def importance_sample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", n: int = RUN, buckets: int = BUCKETS, percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """One row a document: doc_id, n_features, weight, score, rank (null where it is not drawn), n_words."""
    found = materialise(feature_buckets(docs, id_col, text_col, n, buckets), "features")
    gain = gains(bucket_totals(found, buckets), bucket_totals(feature_buckets(target, target_col, target_col, n, buckets), buckets))
    scored = weights(found, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return ranked(materialise(scored, "scores"), percent, least).select("doc_id", "n_features", "weight", "score", "rank", "n_words")

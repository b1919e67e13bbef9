"""Exact deduplication by two-pass Bloom filtering.

Pass one adds every text hash to a table of saturating counters of a fixed size.  A text
that occurs twice finds all its counters at two or more, so pass two splits the rows:
those below two in any counter are unique and pass straight through; only the others
are shuffled and grouped by their full SHA-256.  A corpus with more rows than one filter
serves is written by ranges of the hash, and each range has a filter of its own, so the
share of rows that shuffle does not grow with the corpus.  Beyond MOST_RANGES filters are
fuller, which costs shuffle, never a wrong answer.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import BitSet, bucket_counts
from .common import ascii_lower, materialise, mix64

#: Counters per row, and hash functions per row.
BUCKETS_A_ROW = 16
HASHES = 5
#: Bounds of a filter (2**26 counters are 64 MB in a task and on the driver, 8 MB as broadcast bits), and of ranges.
LOG2_LEAST, LOG2_MOST, MOST_RANGES = 12, 26, 256
#: A text held by more than this share of all rows is met by broadcast: at most 1 / HOT_SHARE such texts exist.
HOT_SHARE = 0.001


def text_sha256(col):
    """SHA-256 (hex) of a text after lower-casing A-Z; null counts as empty."""
    return F.sha2(ascii_lower(F.coalesce(col, F.lit(""))).cast("binary"), 256)


def _places(h: np.ndarray, log2: int) -> np.ndarray:
    """HASHES bucket numbers for each hash: rows by hash functions."""
    a = mix64(h.astype(np.uint64))
    b = mix64(a) | np.uint64(1)
    return (a[:, None] + np.arange(HASHES, dtype=np.uint64) * b[:, None]) & np.uint64((1 << log2) - 1)


def maybe_repeated(df: DataFrame, key: str, rows: int, log2: int | None = None):
    """A Boolean column: False only where no other row can have the same 64-bit `key`.

    `df` is read once (its `key` column only) to fill the filter, whose size follows `rows` up to a fixed limit.
    """
    log2 = log2 or min(LOG2_MOST, max(LOG2_LEAST, (BUCKETS_A_ROW * max(rows, 1) - 1).bit_length()))

    def positions(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [_places(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), log2).ravel().astype(np.int64)]

    twice = df.sparkSession.sparkContext.broadcast(BitSet(bucket_counts(df.select(key), positions, log2, top=2) >= 2))

    @F.pandas_udf("boolean")
    def seen_twice(h: pd.Series) -> pd.Series:
        return pd.Series(twice.value.has(_places(h.to_numpy(np.int64).view(np.uint64), log2)).all(axis=1))

    return seen_twice(F.col(key))


def mark_repeated(df: DataFrame, key: str, rows: int, log2: int | None = None) -> DataFrame:
    """`df` with maybe_repeated in the column `again`, by ranges of `key` where one filter would be too small."""
    ranges = min(MOST_RANGES, -(-BUCKETS_A_ROW * rows // (1 << (log2 or LOG2_MOST))))
    if ranges <= 1:
        return df.withColumn("again", maybe_repeated(df, key, rows, log2))
    names = df.columns
    cut = materialise(df.withColumn("range", F.pmod(F.col(key), F.lit(ranges)).cast("int")), "dedup-ranges", "range")
    out = None
    for r in range(ranges):
        part = cut.filter(F.col("range") == r).select(*names)
        part = part.withColumn("again", maybe_repeated(part, key, -(-rows // ranges), log2))
        out = part if out is None else out.unionByName(part)
    return out


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", log2: int | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null and empty texts are equal.  The row with the
    largest id stays; a null id is below any other.  Of rows that repeat text and id, one has kept = true.
    An empty table gives an empty result; other columns of `docs` are not read.
    """
    rows = materialise(
        docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").alias("doc_id"), text_sha256(F.col(f"`{text_col}`")).alias("sha")).select(
            "rid", "doc_id", F.unhex("sha").alias("sha"), F.conv(F.substring("sha", 1, 15), 16, 10).cast("long").alias("h")
        ),
        "dedup",
    )
    n = rows.count()
    marked = mark_repeated(rows, "h", n, log2)
    columns = lambda keep, size, kept: [F.col("doc_id"), keep.alias("keep_id"), size.alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")]
    alone = marked.filter("not again").select(*columns(F.col("doc_id"), F.lit(1).cast("long"), F.lit(True)))

    again = marked.filter("again").select("rid", "doc_id", "sha")
    groups = materialise(again.groupBy("sha").agg(F.max(F.struct("doc_id", "rid")).alias("best"), F.count(F.lit(1)).alias("size")), "dedup-groups")
    hot = groups.filter(F.col("size") > n * HOT_SHARE).withColumnsRenamed({"best": "hot_best", "size": "hot_size"})
    met = again.join(F.broadcast(hot), "sha", "left")  # at most 1 / HOT_SHARE rows
    finish = lambda df, best, size: df.select(*columns(F.col(f"{best}.doc_id"), F.col(size), F.col(f"{best}.rid") == F.col("rid")))
    cold = met.filter("hot_size is null").select("rid", "doc_id", "sha").join(groups.filter(F.col("size") <= n * HOT_SHARE), "sha")
    return alone.unionByName(finish(met.filter("hot_size is not null"), "hot_best", "hot_size")).unionByName(finish(cold, "best", "size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", log2: int | None = None) -> DataFrame:
    """The rows of `docs`, each distinct text once: the row with the largest id (null lowest) stays, whole.

    Rows whose text cannot repeat are not shuffled.  The others are reduced to one row per text within each task
    before they are, so a text held by a third of all rows costs one row per task.  Ties in id go to the row whose
    columns hash highest.  Column names of `docs` may be any.
    """
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    sha = text_sha256(F.col(f"`{text_col}`"))
    keyed = docs.select(row.alias("r"), F.struct(F.col(f"`{id_col}`").alias("i"), F.xxhash64(*plain).alias("t")).alias("rank"), sha.alias("sha")).withColumn("h", F.conv(F.substring("sha", 1, 15), 16, 10).cast("long"))
    n = docs.count()
    marked = mark_repeated(keyed, "h", n, log2)
    alone = marked.filter("not again").select("r")
    best = marked.filter("again").groupBy("sha").agg(F.max_by("r", "rank").alias("r")).select("r")
    return alone.unionByName(best).select(*[F.col(f"r.`{c}`").alias(c) for c in names])

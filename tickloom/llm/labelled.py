"""Labelled training rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Label tables (an id and a number a row) are broadcast up to this number of rows, else joined by shuffle.
BROADCAST_LABELS = 1_000_000


def remainder(doc_id, mod: int):
    """crc32 of the id as text, modulo `mod`; a null id counts as the empty text (remainder 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int, id_col: str = "doc_id", text_col: str = "text", most: int | None = None) -> DataFrame:
    """(text, y) of labelled documents outside the held-out fold; y is 0 or 1.

    With `most`, the labelled ids with the least hashes, as many as that.  Null labels are no labels; an id labelled
    twice has the larger label.
    """
    ids = labels.select(F.col(f"`{id_col}`").alias("lid"), F.col(f"`{label}`").cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("lid").isNotNull() & (remainder(F.col("lid"), mod) != held))
    ids = ids.groupBy("lid").agg(F.max("y").alias("y"))
    if most:
        ids = ids.orderBy(F.xxhash64("lid"), "lid").limit(most)
    texts = docs.select(F.col(f"`{id_col}`").alias("lid"), F.col(f"`{text_col}`").alias("text"))
    few = most and most <= BROADCAST_LABELS or labels.count() <= BROADCAST_LABELS
    return texts.join(F.broadcast(ids) if few else ids, "lid").select("text", "y")

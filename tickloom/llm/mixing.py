"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a 60-bit hash.  Word counts are summed by source and the hash's top 12 bits; the
bucket in which a source's budget runs out is found from the running sums, and only the rows of that
bucket are summed again by the next 12 bits, and so on to single hashes.  The result is one threshold a
source, so documents are chosen by a comparison and nothing is sorted.  A budget above the source's size
takes every document once and the threshold picks those that are taken again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

WEIGHTS = (3, 1, 2)
BUDGET_SHARE = 1.5
MOST_COPIES = 2
BITS, LEVELS = 12, 5
#: A table of one row per source is broadcast up to this many sources (some MB), else joined by shuffle.
BROADCAST_SOURCES = 50_000


def word_count(text):
    """Runs of anything but ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix_hash(doc_id, text):
    """60 bits of the MD5 of id and text: the same on every run and in any partitioning."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, 15), 16, 10).cast("long")


def source_key(source):
    """A join key that keeps null apart from every name."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def _sources(df: DataFrame, rows: DataFrame, sources: int) -> DataFrame:
    return rows.join(F.broadcast(df) if sources <= BROADCAST_SOURCES else df, "sk")


def mix_targets(sizes: DataFrame, weights=WEIGHTS, budget_share: float = BUDGET_SHARE, most: int = MOST_COPIES) -> DataFrame:
    """Adds `target` to a table of one row per source (sk, source, source_size).

    Sources by code point, null last, get `weights` in turn and share the budget; none gets more than `most` times
    its size.  With r = most * size / weight, the level of an uncapped source is the largest of (budget - caps of
    smaller r) / (weights of the others), so one ordered pass over the sources finds it.
    """
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = sizes.withColumn("w", F.element_at(F.array(*[F.lit(x) for x in weights]), (order % len(weights)).cast("int") + 1))
    w = w.withColumns({"cap": F.col("source_size") * most, "r": F.col("source_size") * float(most) / F.col("w")})
    before, whole = Window.orderBy("r", "sk").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("r", "sk").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) * budget_share - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    w = w.withColumn("level", level)
    return w.select("sk", "source_size", F.least(F.col("cap").cast("double"), F.max("level").over(whole) * F.col("w")).alias("target"))


def mix_thresholds(rows: DataFrame, weights=WEIGHTS, budget_share: float = BUDGET_SHARE, most: int = MOST_COPIES) -> tuple[DataFrame, int]:
    """(sk, source_size, target, base, bound) and the number of sources, from rows (sk, source, size, h).

    A document is taken `base` times, and once more if its h is below `bound`.  Each source's words end within half
    of the size of the document (or of the documents of one hash: repeated rows) at its bound.
    """
    sizes = materialise(rows.groupBy("sk").agg(F.first("source").alias("source"), F.sum("size").alias("source_size")), "mix-sizes")
    sources = sizes.count()
    targets = mix_targets(sizes, weights, budget_share, most)
    base = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most - 1))).otherwise(0).cast("int")
    targets = targets.withColumn("base", base).withColumn("rest", F.col("target") - F.col("base") * F.col("source_size"))
    targets = materialise(targets, "mix-targets")

    state = targets.select("sk", "rest", F.lit(0).cast("long").alias("path"), F.lit(0).cast("long").alias("before"))
    here = rows.select("sk", "size", "h")
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        if level:
            here = _sources(state.select("sk", "path"), here, sources).filter(F.shiftright("h", shift + BITS) == F.col("path")).drop("path")
        if level == 1:
            here = materialise(here, "mix-boundary")
        counts = here.groupBy("sk", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        run = Window.partitionBy("sk").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        counts = _sources(state.select("sk", "rest", "before"), counts, sources).withColumn("upto", F.col("before") + F.sum("words").over(run))
        # The first bucket that passes the rest of the budget; a source without one is taken whole.
        passed = counts.filter(F.col("upto") > F.col("rest")).groupBy("sk").agg(F.min(F.struct("bucket", "upto", "words", "rest")).alias("m"))
        state = passed.select("sk", "m.rest", F.col("m.bucket").alias("path"), (F.col("m.upto") - F.col("m.words")).alias("before"), F.col("m.words").alias("words"))
        state = materialise(state, f"mix-level{level}")
    nearer = F.when(F.col("rest") * 2 >= F.col("before") * 2 + F.col("words"), 1).otherwise(0)
    bounds = state.select("sk", (F.col("path") + nearer).alias("bound"))
    whole = F.lit(1 << (BITS * LEVELS)).cast("long")
    return targets.join(bounds, "sk", "left").select("sk", "source_size", "target", "base", F.coalesce("bound", whole).alias("bound")), sources


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, budget_share: float = BUDGET_SHARE, most: int = MOST_COPIES) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats counted), copies.

    Null text is empty and takes nothing; null sources are one source, last in order; rows equal in id and text share
    one decision; an empty table gives an empty result.  Other columns are not read.
    """
    text = F.col(f"`{text_col}`")
    rows = materialise(
        docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), word_count(text).alias("size"), mix_hash(F.col(f"`{id_col}`"), text).alias("h")).withColumn("sk", source_key(F.col("source"))),
        "mix",
    )
    bounds, sources = mix_thresholds(rows, weights, budget_share, most)
    copies = (F.col("base") + F.when(F.col("h") < F.col("bound"), 1).otherwise(0)).cast("int")
    return _sources(bounds, rows, sources).select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def mix_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, budget_share: float = BUDGET_SHARE, most: int = MOST_COPIES) -> DataFrame:
    """The mix itself: rows of `docs` as often as it takes them (0, 1 or 2 times), numbered from 1 in `mix_copy`."""
    text, names = F.col(f"`{text_col}`"), docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("r"), F.col(f"`{source_col}`").alias("source"), mix_hash(F.col(f"`{id_col}`"), text).alias("h")).withColumn("sk", source_key(F.col("source")))
    rows = docs.select(F.col(f"`{source_col}`").alias("source"), word_count(text).alias("size"), mix_hash(F.col(f"`{id_col}`"), text).alias("h")).withColumn("sk", source_key(F.col("source")))
    bounds, sources = mix_thresholds(materialise(rows, "mix"), weights, budget_share, most)
    copies = (F.col("base") + F.when(F.col("h") < F.col("bound"), 1).otherwise(0)).cast("int")
    taken = _sources(bounds, keyed, sources).select("r", copies.alias("n")).filter("n > 0")
    number = "mix_copy" if "mix_copy" not in names else "mix_copy_"
    return taken.select("r", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k")).select(*[F.col(f"r.`{c}`").alias(c) for c in names], F.col("k").alias(number))

"""A training corpus from raw documents: five stages, each of which calls one operator of tickloom.llm.

Each stage works on all that its predecessor kept and returns whole rows with the columns of documents; the last
repeats rows as often as the mix takes them and numbers the copies in mix_copy.

In every stage a null text counts as empty, rows repeat as often as they are there unless the stage drops them, an empty
table gives an empty one, and further columns of any name go through.  Quality scores all empty texts alike; exact
deduplication keeps one empty text; no empty text is similar to another or touched by the benchmark, and the mix takes none
beyond its share of rows, since it has no words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm.common import materialise
from tickloom.llm.decontaminate import drop_contaminated
from tickloom.llm.exact_dedup import exact_dedup
from tickloom.llm.jaccard_join import keep_one_of_similar
from tickloom.llm.mixing import mix_rows
from tickloom.llm.quality import keep_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking model accepts."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each text."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each group of near copies."""
    return keep_one_of_similar(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them."""
    return mix_rows(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("decontaminate", benchmark), ("mix", mix)]

#: A trained classifier decides the first stage, which SQL can't express; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

"""Validation rules and table statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import all_finite
from ..schemas import FEATURE_CATEGORIES, RULES


def validate(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows with the names of the rules they break); a null passes, as in SQL checks."""
    broken = F.array_compact(F.array(*[F.when(~F.expr(rule), F.lit(name)) for name, rule in RULES[table].items()]))
    marked = df.withColumn("broken", broken)
    return marked.filter(F.size("broken") == 0).drop("broken"), marked.filter(F.size("broken") > 0)


def filled_rates(features: DataFrame, categories: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(category, rate): share of cells that are numbers, in one scan; 0 for an empty table."""
    categories = categories or FEATURE_CATEGORIES
    filled = [sum((F.count_if(F.col(n).isNotNull() & ~F.isnan(n)) for n in names[1:]), F.count_if(F.col(names[0]).isNotNull() & ~F.isnan(names[0]))).alias(c) for c, names in categories.items()]
    one = features.agg(*filled, F.count(F.lit(1)).alias("_rows"))
    cells = F.array(*[F.struct(F.lit(c).alias("category"), F.when(F.col("_rows") > 0, F.col(c) / (F.col("_rows") * len(n))).otherwise(0.0).alias("rate")) for c, n in categories.items()])
    return one.select(F.inline(cells))


def finite_rows(features: DataFrame, names) -> DataFrame:
    """Rows in which all of `names` are numbers."""
    return features.filter(all_finite(names))


def table_stats(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.min("time").alias("oldest"), F.max("time").alias("newest"))


def throughput(before: DataFrame, after: DataFrame, seconds: float, size: int) -> DataFrame:
    """Rows a second and a day, and bytes a row, from two table_stats some seconds apart."""
    a = after.select(F.col("n_rows").alias("n"))
    rate = (F.col("n") - F.col("n_rows")) / F.lit(float(seconds))
    return before.select("n_rows").join(F.broadcast(a), F.lit(True)).select(rate.alias("rows_a_second"), (rate * 86400).alias("rows_a_day"), F.when(F.col("n") > 0, F.lit(float(size)) / F.col("n")).alias("bytes_a_row"))

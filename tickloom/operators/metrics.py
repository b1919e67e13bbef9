"""Classification metrics over (y, p) columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _classes(df: DataFrame, n: int) -> DataFrame:
    return df.sparkSession.range(n).select(F.col("id").cast("int").alias("y"))


def class_weights(df: DataFrame, n_classes: int = 3) -> DataFrame:
    """(y, weight): total / (classes * count); an empty class counts 1, also in the total."""
    counts = _classes(df, n_classes).join(df.groupBy("y").agg(F.count(F.lit(1)).alias("n")), "y", "left").select("y", F.greatest(F.coalesce("n", F.lit(1)), F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total), F.lit(True)).select("y", (F.col("total") / (n_classes * F.col("n"))).alias("weight"))


def confusion(df: DataFrame, n_classes: int = 3) -> DataFrame:
    """One row per true class with a column p0, p1, … per predicted class."""
    counts = df.groupBy("y").agg(*[F.count_if(F.col("p") == k).alias(f"p{k}") for k in range(n_classes)])
    return _classes(df, n_classes).join(counts, "y", "left").na.fill(0)


def scores(df: DataFrame, n_classes: int = 3) -> DataFrame:
    """(y, precision, recall, f1, accuracy, macro_f1); 0 where a denominator is empty; macro means all classes count alike."""
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    agg = [F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == F.col("p")).alias("right")]
    for k in range(n_classes):
        y, p = F.col("y") == k, F.col("p") == k
        agg += [F.count_if(y & p).alias(f"t{k}"), F.count_if(y).alias(f"y{k}"), F.count_if(p).alias(f"p{k}")]
    one = df.agg(*agg)
    per = []
    for k in range(n_classes):
        t, y, p = (F.col(f"{c}{k}") for c in "typ")
        per.append(F.struct(F.lit(k).alias("y"), div(t, p).alias("precision"), div(t, y).alias("recall"), div(2 * t, y + p).alias("f1")))
    one = one.select(div(F.col("right"), F.col("n")).alias("accuracy"), F.array(*per).alias("per"))
    macro = F.aggregate("per", F.lit(0.0), lambda a, x: a + x["f1"]) / n_classes
    return one.select("accuracy", macro.alias("macro_f1"), F.inline("per")).select("y", "precision", "recall", "f1", "accuracy", "macro_f1")


def weighted_cross_entropy(df: DataFrame, weights: DataFrame) -> DataFrame:
    """One row `loss` from (y, w, probs): sum of -ln p[y] * class weight * w over the sum of w."""
    met = df.join(F.broadcast(weights), "y")
    p = F.greatest(F.get("probs", F.col("y")), F.lit(1e-300))
    return met.agg((F.sum(-F.ln(p) * F.col("weight") * F.col("w")) / F.greatest(F.sum("w"), F.lit(1e-8))).alias("loss"))

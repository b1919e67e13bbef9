"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
QUERIES = ("bars", "features_returns", "features_book", "features_cross", "asof_join", "triple_barrier", "labels", "walk_forward", "order_plans", "risk_gate", "monitoring", "positions", "book_levels", "features_all")
REPEATS = 3


def feature_inputs(spark: SparkSession, bars: int, book_bars: int, snaps: int) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Two symbols of 5-minute bars, an order book on the last bars, and funding; made by Spark before the clock starts."""
    start = int(pd.Timestamp("2026-01-01").timestamp())
    at = lambda k: F.timestamp_seconds(F.lit(start) + k)
    base = spark.range(bars).withColumn("symbol", F.explode(F.array(F.lit("BTC"), F.lit("ETH"))))
    price = lambda k: 100 * F.exp(0.02 * F.sin(k * 0.37) + 0.01 * F.cos(k * 1.7))
    k = F.col("id")
    o, c = price(k - 1), price(k)
    b = base.select("symbol", at(k * 300).alias("time"), o.alias("open"), (F.greatest(o, c) * 1.001).alias("high"), (F.least(o, c) * 0.999).alias("low"), c.alias("close"), (100 + 20 * F.sin(k * 0.9)).alias("volume"), (k % 50 + 1).cast("int").alias("trades"))
    f = base.select("symbol", at(k * 300).alias("time"), (1e-4 * F.sin(k * 0.1)).alias("funding_rate"), (1e6 + 1e4 * F.cos(k * 0.2)).alias("open_interest"))
    book = None
    if book_bars:
        n = spark.range(book_bars * snaps).withColumn("symbol", F.explode(F.array(F.lit("BTC"), F.lit("ETH"))))
        sec = (bars - book_bars) * 300 + k * 300.0 / snaps
        mid, steps = 100 + F.sin(k * 0.01), F.sequence(F.lit(0), F.lit(19))
        book = n.select("symbol", at(sec).alias("time"), F.transform(steps, lambda i: mid - 0.05 - 0.1 * i).alias("bid_px"), F.transform(steps, lambda i: 1 + (k + i) % 7.0).alias("bid_sz"), F.transform(steps, lambda i: mid + 0.05 + 0.1 * i).alias("ask_px"), F.transform(steps, lambda i: 1 + (k + 2 * i) % 5.0).alias("ask_sz"))
    out = [x and x.persist() for x in (b, book, f)]
    for x in out:
        if x is not None:
            x.count()
    return tuple(out)


def main() -> None:
    from tickloom.operators.features import compute_features
    from tickloom.plans.market import QUERIES as ALL

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(make) -> float:
        began = time.time()
        make().write.format("noop").mode("overwrite").save()
        return time.time() - began

    took = {}
    for name in QUERIES:
        times = [timed(lambda: ALL[name](spark, SF)) for _ in range(REPEATS)]
        took[name] = round(median(times[1:]), 3)
    shapes = {"features_nobook": (1128, 0, 0), "features_200x60": (1128, 200, 60), "features_200x300": (1128, 200, 300), "features_1128x60": (1128, 1128, 60), "features_112800": (112_800, 0, 0)}
    for name, shape in shapes.items():
        bars, book, funding = feature_inputs(spark, *shape)
        times = [timed(lambda: compute_features(bars, book, funding)) for _ in range(REPEATS)]
        took[name] = round(median(times[1:]), 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF, "cpus": int(CPUS)}))


if __name__ == "__main__":
    main()

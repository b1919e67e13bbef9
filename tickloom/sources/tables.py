"""Table scans and keyed writes on Parquet folders."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import BAR_SECONDS, CONFLICT, KEYS, TABLES


def _stored(table: str) -> T.StructType:
    """The schema of a table's files and partition folders."""
    return T.StructType([*TABLES[table].fields, T.StructField("date", T.DateType())])


def resolve_root(env: Mapping[str, str] | None = None) -> str:
    """Where the tables lie: TICKLOOM_ROOT, or a folder under TICKLOOM_HOME."""
    env = os.environ if env is None else env
    return env.get("TICKLOOM_ROOT") or f"{env.get('TICKLOOM_HOME', '.')}/tables"


def create_tables(spark: SparkSession, root: str) -> None:
    """Empty tables with their schemas, where there are none."""
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).withColumn("date", F.to_date("time")).write.mode("ignore").partitionBy("symbol", "date").parquet(f"{root}/{name}")


def scan(spark: SparkSession, root: str, table: str, columns: Sequence[str] | None = None, symbols: Sequence[str] | None = None, since=None, where: Column | None = None) -> DataFrame:
    """Columns of a table (its date among them, if asked for); symbol and time bounds, and `where`, prune partitions and reach the Parquet scan."""
    df = spark.read.schema(_stored(table)).parquet(f"{root}/{table}")
    df = df.filter(where) if where is not None else df
    if symbols:
        df = df.filter(F.col("symbol").isin(*symbols))
    if since is not None:
        df = df.filter((F.col("time") >= F.lit(since)) & (F.col("date") >= F.to_date(F.lit(since))))
    return df.select(*(columns or TABLES[table].names))


def last_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str] = (), first: bool = False) -> DataFrame:
    """One whole row for each key: the last by `order` (the first with `first`)."""
    row, rank = F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(*order) if order else F.lit(0)
    best = df.groupBy(*keys).agg((F.min_by if first else F.max_by)(row, rank).alias("_r"))
    return best.select("_r.*")


#: Partitions that a write names one by one; with more, it reads all of the days between the first and the last.
MOST_PARTITIONS = 2000


def touched_partitions(fresh: DataFrame) -> Column:
    """A predicate over the partition columns that holds for those of `fresh` (symbol, date), made of literals so that scans prune."""
    pairs = fresh.select("symbol", "date").distinct().limit(MOST_PARTITIONS + 1).collect()
    if len(pairs) > MOST_PARTITIONS:
        first, last = fresh.agg(F.min("date"), F.max("date")).first()
        return F.col("date").between(F.lit(first), F.lit(last))
    days: dict[str, list] = {}
    for p in pairs:
        days.setdefault(p["symbol"], []).append(p["date"])
    out = F.lit(False)
    for symbol, some in sorted(days.items()):
        out = out | ((F.col("symbol") == symbol) & F.col("date").isin(*some))
    return out


def write_keyed(df: DataFrame, root: str, table: str, order: str = "_seq") -> None:
    """Upsert (or insert-ignore, or append) into a table partitioned by symbol and date.

    `order` numbers the incoming rows and is not stored.  Only partitions that the rows touch are read and replaced.
    """
    spark, path, keys = df.sparkSession, f"{root}/{table}", KEYS[table]
    df = df if order in df.columns else df.withColumn(order, F.monotonically_increasing_id())
    fresh = df.withColumn("date", F.to_date("time"))
    names = [*TABLES[table].names, "date"]
    kinds = {f.name: f.dataType for f in _stored(table)}
    fresh = fresh.select(*[(F.col(c) if c in fresh.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in names], order)
    how = CONFLICT.get(table, "last")
    if how == "append":
        fresh.drop(order).write.mode("append").partitionBy("symbol", "date").parquet(path)
        return
    fresh = fresh.persist()
    try:
        there = spark.read.schema(_stored(table)).parquet(path).filter(touched_partitions(fresh))
        there = there.select(*names).withColumn("_new", F.lit(0)).withColumn(order, F.lit(None).cast(fresh.schema[order].dataType))
        both = there.unionByName(fresh.withColumn("_new", F.lit(1)))
        kept = last_by_key(both, keys, ("_new", order), first=how == "first").drop("_new", order)
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "date").parquet(path)
    finally:
        fresh.unpersist()


def number_orders(df: DataFrame, start: int = 0) -> DataFrame:
    """order_id counting up from `start` by time; rows are numbered within their day, after the rows of earlier days."""
    days = df.groupBy(F.to_date("time").alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    days = days.withColumn("_before", F.sum("_n").over(Window.orderBy("_day")) - F.col("_n"))  # one row a day
    inside = F.row_number().over(Window.partitionBy("_day").orderBy("time", "symbol", "intent"))
    met = df.withColumn("_day", F.to_date("time")).withColumn("_place", inside).join(days, "_day")
    return met.withColumn("order_id", (F.col("_before") + F.col("_place") + start).cast("long")).drop("_day", "_n", "_before", "_place")


def closed_bars(bars: DataFrame, now: Column, seconds: int = BAR_SECONDS) -> DataFrame:
    """Bars that have ended by `now`."""
    return bars.filter(F.unix_micros("time") + seconds * 1_000_000 <= F.unix_micros(now))


def write_metadata(spark: SparkSession, path: str, content: dict) -> None:
    """A JSON document in a folder of its own, by Spark's file system."""
    spark.createDataFrame([(json.dumps(content),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_metadata(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).filter("trim(value) <> ''").first()["value"])

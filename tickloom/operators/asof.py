"""As-of join: for each left row the last right row at or before its time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import DAY


def asof_join(left: DataFrame, right: DataFrame, values: Sequence[str], by: Sequence[str] = ("symbol",), time: str = "time", tie: Sequence[str] = (), bucket: int | None = DAY) -> DataFrame:
    """`left` with `values` of the matched right row, null where there is none.

    Both sides are put together and the last right row is carried forward as a whole, so a null in the matched row stays
    null.  At equal times the right row counts; among right rows of one time the last by `tie`.

    Rows are ordered within time buckets of `bucket` seconds.  What was the last right row before each bucket comes from
    one row a bucket and leads the bucket as a row of its own, so a key with many rows is spread over tasks by its buckets,
    and a match may lie any number of buckets back.  None keeps the rows of a key together (for many keys of few rows).
    """
    keys = [*by, time]
    rest = [c for c in left.columns if c not in keys]
    a = left.select(*keys, F.struct(*[F.col(f"`{c}`") for c in rest] or [F.lit(1).alias("_one")]).alias("_l"), F.lit(1).alias("_side"))
    b = right.select(*keys, *tie, F.struct(*values).alias("_r"), F.lit(0).alias("_side"))
    both, part = a.unionByName(b, allowMissingColumns=True), list(by)
    if bucket is not None:
        both, part = both.withColumn("_bucket", F.floor(F.unix_seconds(time) / F.lit(bucket)).cast("long")), [*by, "_bucket"]
        last = both.groupBy(*part).agg(F.max_by("_r", F.when(F.col("_side") == 0, F.struct(time, *tie))).alias("_r"))
        earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        led = last.withColumn("_r", F.last("_r", ignorenulls=True).over(earlier)).filter("_r is not null")
        both = both.unionByName(led.select(*part, "_r", F.lit(-1).alias("_side")), allowMissingColumns=True)
    # A leading row has no time, and nulls come first.
    w = Window.partitionBy(*part).orderBy(time, "_side", *tie).rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("_m", F.last("_r", ignorenulls=True).over(w)).filter("_side = 1")
    return carried.select(*keys, *[F.col(f"_l.`{c}`").alias(c) for c in rest], *[F.col(f"_m.{v}").alias(v) for v in values])

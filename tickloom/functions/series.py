"""Ordered-series kernels: row windows that are valid only when full, and bounded partitions for long series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.scratch import kept
from .exprs import _c, fdiv


class Series:
    """Windows over one partitioning and order; every rolling value is null until its `n` rows are there."""

    def __init__(self, by: Sequence[str] = ("symbol",), order: Sequence[str] = ("time",)) -> None:
        self.spec: WindowSpec = Window.partitionBy(*by).orderBy(*order)

    def last(self, n: int) -> WindowSpec:
        return self.spec.rowsBetween(-(n - 1), 0)

    def lag(self, x, k: int = 1) -> Column:
        return F.lag(_c(x), k).over(self.spec)

    def lead(self, x, k: int = 1) -> Column:
        return F.lead(_c(x), k).over(self.spec)

    def index(self) -> Column:
        return F.row_number().over(self.spec) - 1

    def full(self, n: int, x, value) -> Column:
        """`value` (an aggregate) over the last n rows, where x is there in all of them."""
        return F.when(F.count(_c(x)).over(self.last(n)) == n, value.over(self.last(n)))

    def sum(self, x, n: int) -> Column:
        return self.full(n, x, F.sum(_c(x)))

    def mean(self, x, n: int) -> Column:
        return self.full(n, x, F.avg(_c(x)))

    def std(self, x, n: int) -> Column:
        return self.full(n, x, F.stddev_samp(_c(x)))

    def std_pop(self, x, n: int) -> Column:
        return self.full(n, x, F.stddev_pop(_c(x)))

    def min(self, x, n: int) -> Column:
        return self.full(n, x, F.min(_c(x)))

    def max(self, x, n: int) -> Column:
        return self.full(n, x, F.max(_c(x)))

    def zscore(self, x, n: int) -> Column:
        return fdiv(_c(x) - self.mean(x, n), self.std(x, n))

    def cov_pop(self, x, y, n: int) -> Column:
        return self.full(n, _c(x) * _c(y), F.covar_pop(_c(x), _c(y)))

    def var_pop(self, x, n: int) -> Column:
        return self.full(n, x, F.var_pop(_c(x)))

    def corr(self, x, y, n: int) -> Column:
        """Not a number where either side is constant."""
        both = _c(x) * _c(y)
        return fdiv(self.full(n, both, F.covar_pop(_c(x), _c(y))), F.sqrt(self.full(n, both, F.var_pop(_c(x))) * self.full(n, both, F.var_pop(_c(y)))))


def latest(df: DataFrame, by: Sequence[str] = ("symbol",), order: Sequence[str] = ("time",), n: int = 1) -> DataFrame:
    """The last n rows of each key by `order`; one pass with a map-side limit."""
    w = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= n).drop("_place")


DAY = 86_400
#: Rows of one chunk of a long series.
ROWS_A_CHUNK = 50_000


def numbered(df: DataFrame, by: Sequence[str] = ("symbol",), time: str = "time", tie: Sequence[str] = (), seconds: int = DAY, once: bool = True) -> DataFrame:
    """`df` with idx, the place of a row in its series from 0, and rows, the length of the series.

    Rows are numbered within time buckets of `seconds`, after the rows of the buckets before, which come from one count a
    bucket: no task orders more than a bucket of a series.  Rows are read for both; with `once`, what makes them runs once
    and is written to the shared folder (leave it out for a stored table).
    """
    cut = (kept(df, "rows") if once else df).withColumn("_bucket", F.floor(F.unix_seconds(F.col(time)) / F.lit(seconds)).cast("long"))
    whole = Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    before = cut.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = before.select(*by, "_bucket", (F.sum("_n").over(upto) - F.col("_n")).alias("_before"), F.sum("_n").over(whole).alias("rows"))
    place = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(time, *tie)) - 1
    return cut.withColumn("_place", place).join(before, [*by, "_bucket"]).withColumn("idx", (F.col("_before") + F.col("_place")).cast("long")).drop("_bucket", "_before", "_place")


def in_chunks(df: DataFrame, halo: int, rows: int = ROWS_A_CHUNK, idx: str = "idx") -> DataFrame:
    """Numbered rows with chunk and own: runs of `rows` rows of a series, each led by the `halo` rows before it (own is false).

    Kernels that look back up to `halo` rows give the same results on (series, chunk) as on the whole series, in groups of
    bounded size; keep the rows with `own` afterwards.
    """
    rows = max(rows, halo, 1)
    at = F.floor(F.col(idx) / rows).cast("long")
    chunks = F.when(F.col(idx) % rows >= rows - halo, F.array(at, at + 1)).otherwise(F.array(at)) if halo else F.array(at)
    return df.withColumn("chunk", F.explode(chunks)).withColumn("own", F.col("chunk") == at)


def longest(df: DataFrame, by: Sequence[str] = ("symbol",)) -> int:
    """Rows of the longest series of a stored table."""
    return df.groupBy(*by).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]


def bounded(df: DataFrame, halo: int, rows: int = ROWS_A_CHUNK, tie: Sequence[str] = ()) -> DataFrame:
    """A stored table with chunk and own, as `in_chunks` gives them; one chunk a series where none is longer than `rows`."""
    if longest(df) <= rows:
        return df.withColumns({"chunk": F.lit(0).cast("long"), "own": F.lit(True)})
    return in_chunks(numbered(df, tie=tie, once=False), halo, rows)


def running_sum(df: DataFrame, x, out: str, by: Sequence[str] = ("symbol",), idx: str = "idx", rows: int = ROWS_A_CHUNK) -> DataFrame:
    """`df` with `out`, the sum of x up to and with each row by idx: sums within chunks after the sums of the chunks before."""
    cut = df.withColumns({"_chunk": F.floor(F.col(idx) / rows).cast("long"), "_x": F.coalesce(_c(x), F.lit(0))})
    upto = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)
    before = cut.groupBy(*by, "_chunk").agg(F.sum("_x").alias("_sum")).select(*by, "_chunk", (F.sum("_sum").over(upto) - F.col("_sum")).alias("_before"))
    inside = F.sum("_x").over(Window.partitionBy(*by, "_chunk").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("_inside", inside).join(before, [*by, "_chunk"]).withColumn(out, F.col("_before") + F.col("_inside")).drop("_chunk", "_x", "_inside", "_before")

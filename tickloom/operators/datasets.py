"""Training samples, purged walk-forward folds and normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import all_finite, clip
from ..functions.series import ROWS_A_CHUNK, Series, in_chunks, latest, numbered
from ..schemas import BAR_MINUTES, CLIP_SIGMA, EMBARGO_BARS, FEATURE_NAMES, N_SPLITS, SEQ_LEN, SYMBOLS, VAL_FRACTION
from ..sources.scratch import kept
from ..sources.tables import scan


def labelled_events(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels with the row number of their feature row; labels without one are dropped, missing t1 and weight filled."""
    rows = numbered(features.select("symbol", "time")).select("symbol", "time", F.col("idx").alias("e_idx"))
    found = labels.join(rows, ["symbol", "time"])
    return found.select("symbol", "e_idx", "time", F.coalesce("t1", "time").alias("t1"), "label", F.coalesce("sample_weight", F.lit(1.0)).alias("weight"))


def samples(features: DataFrame, labels: DataFrame, seq_len: int = SEQ_LEN, names: Sequence[str] = FEATURE_NAMES, windows: bool = False, rows: int = ROWS_A_CHUNK) -> DataFrame:
    """(symbol, e_idx, t0, t1, y, w) of labels with `seq_len` feature rows that are finite throughout; y is label + 1.

    A rolling count of finite rows replaces a look at every window, by chunks of a series that the rows before lead; with
    `windows`, `x` holds the matrix itself, gathered for rows with a label only.
    """
    cut = in_chunks(numbered(features.select("symbol", "time", *names)), seq_len - 1, rows)
    s, marked = Series(("symbol", "chunk"), ("idx",)), labels.select("symbol", "time", F.lit(True).alias("_labelled")).distinct()
    cut = cut.withColumn("_ok", all_finite(names).cast("int"))
    keep = {"_n": F.sum("_ok").over(s.last(seq_len))}
    if windows:
        cut = cut.join(marked, ["symbol", "time"], "left").withColumn("_row", F.array(*[F.col(n).cast("float") for n in names]))
        keep["x"] = F.when(F.col("_labelled"), F.collect_list("_row").over(s.last(seq_len)))
    whole = cut.withColumns(keep).filter(F.col("own") & (F.col("_n") == seq_len)).select("symbol", "time", F.col("idx").alias("e_idx"), *(["x"] if windows else []))
    found = labels.join(whole, ["symbol", "time"])
    return found.select("symbol", "e_idx", F.col("time").alias("t0"), F.coalesce("t1", "time").alias("t1"), (F.col("label") + 1).cast("int").alias("y"), F.coalesce("sample_weight", F.lit(1.0)).alias("w"), *(["x"] if windows else []))


def stored_samples(spark: SparkSession, root: str, symbols: Sequence[str] = SYMBOLS, seq_len: int = SEQ_LEN, names: Sequence[str] = FEATURE_NAMES, windows: bool = False) -> tuple[DataFrame, DataFrame]:
    """(features, samples) of the stored bar_features and labels."""
    features, labels = scan(spark, root, "bar_features", symbols=symbols), scan(spark, root, "labels", symbols=symbols)
    return features, samples(features, labels, seq_len, names, windows)


def latest_windows(features: DataFrame, seq_len: int = SEQ_LEN, names: Sequence[str] = FEATURE_NAMES) -> DataFrame:
    """(symbol, time, sigma, x) of each symbol's last `seq_len` rows; x is null where they are fewer or not all finite.

    Rows are cut to the last ones before they are gathered, so a group holds `seq_len` rows at most.
    """
    rows = latest(features, n=seq_len).withColumn("_row", F.struct("time", F.array(*[F.col(n).cast("float") for n in names]).alias("v"), all_finite(names).alias("ok")))
    last = rows.groupBy("symbol").agg(F.max("time").alias("time"), F.max_by("sigma_ewma", "time").alias("sigma") if "sigma_ewma" in features.columns else F.lit(None).cast("double").alias("sigma"), F.sort_array(F.collect_list("_row")).alias("r"))
    whole = (F.size("r") == seq_len) & F.forall("r", lambda r: r["ok"])
    return last.select("symbol", "time", "sigma", F.when(whole, F.transform("r", lambda r: r["v"])).alias("x"))


def fold_edges(found: DataFrame, n_splits: int = N_SPLITS) -> DataFrame:
    """(fold, test_start, test_end): order statistics of t0 at equal steps, one row a fold.

    Times are counted before they are ranked, so the single-task rank sees distinct times only.
    """
    w = Window.orderBy("t0").rowsBetween(Window.unboundedPreceding, 0)
    times = found.groupBy("t0").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(w))
    total = times.agg(F.max("upto").alias("total"))
    steps = total.select("total", F.explode(F.sequence(F.lit(0), F.lit(n_splits + 1))).alias("k"))
    steps = steps.select("k", F.least(F.bround(F.col("k") / F.lit(float(n_splits + 1)) * F.col("total")).cast("long"), F.col("total") - 1).alias("at"))
    edges = steps.join(times, (F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("n"))).select("k", "t0")
    ends = edges.select((F.col("k") - 1).alias("k"), F.col("t0").alias("test_end"))
    return edges.withColumnRenamed("t0", "test_start").join(ends, "k").filter(F.col("k").between(1, n_splits)).withColumnRenamed("k", "fold")


def walk_forward(found: DataFrame, n_splits: int = N_SPLITS, embargo_bars: int = EMBARGO_BARS, bar_minutes: int = BAR_MINUTES) -> DataFrame:
    """Samples with (fold, role): test blocks in time order; training samples end before the block by the embargo.

    A sample has one row for each fold it serves in; folds without either role are left out.  Samples are written once; the
    edges of the few folds come to the driver and go back as literals, so that roles need no join.
    """
    embargo = F.expr(f"make_dt_interval(0, 0, {int(embargo_bars * bar_minutes)}, 0)")
    found = kept(found, "samples")
    t0, roles = F.col("t0"), []
    for k, start, end in fold_edges(found, n_splits).select("fold", "test_start", "test_end").collect():  # a row a fold
        start, end = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
        test = (t0 >= start) & ((t0 <= end) if k == n_splits else (t0 < end))
        train = (t0 < start) & (F.col("t1") < start - embargo)
        roles.append((k, F.when(test, "test").when(train, "train")))
    if roles:
        counts = found.agg(*[F.count_distinct(role).alias(f"f{k}") for k, role in roles]).first()
        roles = [(k, role) for k, role in roles if counts[f"f{k}"] == 2]
    served = F.array(*[F.when(role.isNotNull(), F.struct(F.lit(k).alias("fold"), role.alias("role"))) for k, role in roles]) if roles else F.array().cast("array<struct<fold:int,role:string>>")
    return found.withColumn("_f", F.explode(F.filter(served, lambda f: f.isNotNull()))).select(*found.columns, "_f.fold", "_f.role")


def fold_cutoffs(split: DataFrame, embargo_bars: int = EMBARGO_BARS, bar_minutes: int = BAR_MINUTES) -> DataFrame:
    """(fold, cutoff): bars before it may be used to fit that fold's normaliser."""
    gap = F.expr(f"make_dt_interval(0, 0, {int(embargo_bars * bar_minutes)}, 0)")
    return split.filter("role = 'test'").groupBy("fold").agg((F.min("t0") - gap).alias("cutoff"))


def normaliser(features: DataFrame, cutoffs: DataFrame, names: Sequence[str] = FEATURE_NAMES) -> DataFrame:
    """(fold, name, mean, std): population statistics of the finite rows of all symbols before each fold's cutoff; constant features get 1."""
    rows = features.filter(all_finite(names)).join(F.broadcast(cutoffs), F.col("time") < F.col("cutoff"))
    stats = rows.groupBy("fold").agg(*[F.struct(F.avg(n).alias("mean"), F.stddev_pop(n).alias("std")).alias(n) for n in names])
    long = stats.unpivot("fold", list(names), "name", "s")
    return long.select("fold", "name", "s.mean", F.when(F.col("s.std") < 1e-12, 1.0).otherwise(F.col("s.std")).alias("std"))


def normalise(features: DataFrame, stats: dict[str, tuple[float, float]], bound: float | None = CLIP_SIGMA) -> DataFrame:
    """z-scores with given means and deviations, clipped; null and NaN stay."""
    z = {n: (F.col(n) - m) / F.lit(s) for n, (m, s) in stats.items()}
    return features.withColumns({n: clip(x, -bound, bound) if bound is not None else x for n, x in z.items()})


def final_split(found: DataFrame, val_frac: float = VAL_FRACTION, embargo_bars: int = EMBARGO_BARS, bar_minutes: int = BAR_MINUTES) -> DataFrame:
    """(… role): the last share by t0 is validation; training samples end before it by the embargo."""
    w = Window.orderBy("t0").rowsBetween(Window.unboundedPreceding, 0)
    times = found.groupBy("t0").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(w))  # one row a time
    start = times.agg((F.max("upto") - F.round(F.max("upto") * val_frac)).alias("start"))
    first = times.join(F.broadcast(start), F.col("upto") > F.col("start")).agg(F.min("t0").alias("val_start"))
    gap = F.expr(f"make_dt_interval(0, 0, {int(embargo_bars * bar_minutes)}, 0)")
    met = found.join(F.broadcast(first), F.lit(True))
    role = F.when(F.col("t0") >= F.col("val_start"), "val").when(F.col("t1") < F.col("val_start") - gap, "train")
    return met.withColumn("role", role).filter("role is not null").drop("val_start")

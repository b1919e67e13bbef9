"""The 58 features of a bar: from bars, order book, funding and the other symbol."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import carried as C
from ..functions.bar_series import FROM_BARS, FROM_FUNDING, FROM_OTHER, bar_arrays, funding_arrays, other_arrays
from ..functions.book_series import BEST, LEVELS, PRICED, STATES, bar_sums, levels, quote
from ..functions.exprs import day_cycle, fdiv, finite_or_null, flog
from ..functions.recursive import HALO
from ..functions.series import DAY, ROWS_A_CHUNK, Series, bounded, in_chunks, longest, numbered
from ..schemas import BAR_SECONDS, FEATURE_CATEGORIES, FEATURE_NAMES, RET_HORIZONS
from ..sources.scratch import kept
from .asof import asof_join

BOOK_FEATURES = (*STATES, "spread_z_60", "spread_vol_30", "ofi")
FUNDING_FEATURES, CROSS_FEATURES = FEATURE_CATEGORIES["funding_oi"], FEATURE_CATEGORIES["cross_asset"]


def returns(bars: DataFrame, s: Series) -> DataFrame:
    """Price and return features."""
    df = bars.withColumns({f"ret_{k}": flog(fdiv("close", s.lag("close", k))) for k in RET_HORIZONS} | {
        "ret_co": flog(fdiv("close", "open")), "wick_up": flog(fdiv("high", F.greatest("open", "close"))), "wick_dn": flog(fdiv(F.least("open", "close"), "low")),
        "price_pos_60": fdiv(F.col("close") - s.min("low", 60), s.max("high", 60) - s.min("low", 60)),
    })
    return df.withColumn("ret_accel", F.col("ret_1") - s.lag("ret_1"))


def volatilities(df: DataFrame, s: Series) -> DataFrame:
    """Range and return volatilities; needs ret_1."""
    hl, co, ln2 = F.pow(flog(fdiv("high", "low")), 2), F.pow(flog(fdiv("close", "open")), 2), math.log(2)
    df = df.withColumns({"_hl": hl, "_gk": 0.5 * hl - (2 * ln2 - 1) * co, "_sq": F.pow("ret_1", 2), "_down": F.pow(F.when(F.col("ret_1") < 0, F.col("ret_1")).otherwise(0.0), 2)})
    df = df.withColumns({
        "realized_vol_30": F.sqrt(s.sum("_sq", 30)), "parkinson_30": F.sqrt(s.mean("_hl", 30) / (4 * ln2)), "garman_klass_30": F.sqrt(s.mean("_gk", 30)), "downside_vol_30": F.sqrt(s.mean("_down", 30)),
    })
    return df.withColumn("vol_of_vol_60", s.std("realized_vol_30", 60)).drop("_hl", "_gk", "_sq", "_down")


def volumes(df: DataFrame, s: Series) -> DataFrame:
    return df.withColumns({
        "volume_log": F.log1p("volume"), "volume_z_60": s.zscore("volume", 60), "volume_ratio_5_30": fdiv(s.mean("volume", 5), s.mean("volume", 30)), "trade_count_log": F.log1p(F.col("trades").cast("double")),
    })


def microstructure(df: DataFrame, s: Series) -> DataFrame:
    """Impact and flow features of bars; needs ret_1."""
    ret = F.col("ret_1")
    df = df.withColumns({
        "amihud_illiq": fdiv(F.abs(ret), F.col("close") * F.col("volume")), "_lagged": s.lag("ret_1"), "_flow": F.signum(ret) * F.col("close") * F.col("volume"),
        "_side": F.when(ret > 0, F.col("volume")).when(ret < 0, -F.col("volume")).otherwise(0.0),
    })
    df = df.withColumns({"_cov": s.cov_pop("ret_1", "_lagged", 30), "kyle_lambda": fdiv(s.cov_pop("ret_1", "_flow", 30), s.var_pop("_flow", 30)), "vpin_50": fdiv(F.abs(s.sum("_side", 50)), s.sum("volume", 50))})
    return df.withColumn("roll_spread", 2 * F.sqrt(F.when(F.col("_cov") < 0, -F.col("_cov")).otherwise(0.0))).drop("_lagged", "_flow", "_side", "_cov")


def bands(df: DataFrame, s: Series) -> DataFrame:
    """Technical features without recursion: Bollinger %B and stochastic %K."""
    mean, spread = s.mean("close", 20), s.std_pop("close", 20)
    low, high = s.min("low", 14), s.max("high", 14)
    df = df.withColumns({"_m": mean, "_s": spread, "_lo": low, "_hi": high})
    df = df.withColumns({
        "bb_pctb_20": F.when(F.col("_s") > 0, (F.col("close") - F.col("_m") + 2 * F.col("_s")) / F.expr("nullif(4 * _s, 0)")).when(F.col("_s") == 0, 0.5),
        "stoch_k_14": F.when(F.col("_hi") > F.col("_lo"), (F.col("close") - F.col("_lo")) / F.expr("nullif(_hi - _lo, 0)") * 100).when(F.col("_hi") <= F.col("_lo"), 50.0),
    })
    return df.drop("_m", "_s", "_lo", "_hi")


BAR, OTHER = 0, 1
_NUMBERS = ("open", "high", "low", "close", "volume", "trades", "_rate", "_interest")
_STATE = "matrix array<double>, vector array<double>, n long, mean double, square double, ranged long"


def recursions(df: DataFrame, by: tuple[str, ...] = ("symbol",), rows: int = ROWS_A_CHUNK) -> DataFrame:
    """`df` with CARRIED: log return, volatility, RSI, MACD, ATR and ADX of each series, with idx and rows (place and length).

    Series are cut into chunks of `rows` rows.  Every chunk but the last of a series gives the map of the linear state and
    the moments of its returns; one scan over the chunks of a series turns them into the state at the start of each; the
    averaged directional index, which needs those states, has a second such scan.  Then every chunk is run from its true
    state.  A task holds one chunk; a series of one chunk takes a single pass.  NaN warm-up is null.
    """
    df = kept(df, "series")
    if longest(df, by) <= rows:
        return _recursions_at_once(df, by)
    cut = in_chunks(kept(numbered(df, by, once=False), "numbered"), 1, rows)
    keys, kinds = [*by, "chunk"], {f.name: f.dataType.simpleString() for f in cut.schema}
    names = ", ".join(f"{c} {kinds[c]}" for c in by)
    followed = cut.filter(F.col("chunk") < F.floor((F.col("rows") - 1) / rows)).select(*keys, "idx", "high", "low", "close", "own")

    def chunk_of(group: pa.Table) -> C.Chunk:
        idx = group.column("idx").to_numpy()
        return C.Chunk(int(idx[0]) + (0 if group.column("own")[0].as_py() else 1), *(_numbers(group, c) for c in ("high", "low", "close")))

    def one(group: pa.Table, values: dict) -> pa.Table:
        return pa.table({k: group.column(k).slice(0, 1) for k in keys} | {k: pa.array([v]) for k, v in values.items()})

    def first_pass(group: pa.Table) -> pa.Table:
        part = chunk_of(group.sort_by("idx"))
        (m, b), seen, ranged = part.map(), C.Moments.of(part.ret), part.first_range()
        return one(group, {"matrix": m.ravel().tolist(), "vector": b.tolist(), "n": seen.n, "mean": seen.mean, "square": seen.square}).append_column("ranged", pa.array([ranged], pa.int64()))

    def scan(group: pa.Table) -> pa.Table:
        """From the maps of a series' chunks the state at the start of the chunk after each."""
        group, k = group.sort_by("chunk"), len(C.LINEAR)
        m, b = (np.array(group.column(c).to_pylist()) for c in ("matrix", "vector"))
        _, states = C.prefix_maps(m.reshape(-1, k, k), b)
        seen, first, moments, ranged = C.Moments(), None, [], []
        for n, mean, square, at in zip(*(group.column(c).to_pylist() for c in ("n", "mean", "square", "ranged")), strict=True):
            seen, first = seen.then(C.Moments(n, mean, square)), at if first is None else first
            moments.append(seen)
            ranged.append(first)
        return pa.table({k: group.column(k) for k in by} | {
            "chunk": pc.add(group.column("chunk"), 1), "vector": pa.array(states.tolist(), pa.list_(pa.float64())), "n": pa.array([v.n for v in moments], pa.int64()), "mean": pa.array([v.mean for v in moments]),
            "square": pa.array([v.square for v in moments]), "ranged": pa.array(ranged, pa.int64()),
        })

    def state_of(table: pa.Table) -> tuple[np.ndarray, C.Moments, int | None]:
        if not table.num_rows:
            return np.zeros(len(C.LINEAR)), C.Moments(), None
        row = table.slice(0, 1).to_pylist()[0]
        return np.array(row["vector"]), C.Moments(row["n"], row["mean"], row["square"]), row["ranged"]

    def second_pass(group: pa.Table, state: pa.Table) -> pa.Table:
        if not group.num_rows:
            return pa.table({k: state.column(k).slice(0, 0) for k in keys} | {"decay": pa.array([], pa.float64()), "add": pa.array([], pa.float64())})
        vector, _, ranged = state_of(state)
        dx, at = chunk_of(group.sort_by("idx")).direction(vector, ranged)
        return one(group, {"decay": C._rma_decay(len(dx), at) if len(dx) else 1.0, "add": float(C.rma_from(dx, at, 0.0)[-1]) if len(dx) else 0.0})

    def scan_index(group: pa.Table) -> pa.Table:
        group, z, out = group.sort_by("chunk"), 0.0, []
        for decay, add in zip(group.column("decay").to_pylist(), group.column("add").to_pylist(), strict=True):
            z = decay * z + add
            out.append(z)
        return pa.table({k: group.column(k) for k in by} | {"chunk": pc.add(group.column("chunk"), 1), "index": pa.array(out)})

    def last_pass(group: pa.Table, state: pa.Table) -> pa.Table:
        if not group.num_rows:
            return out_schema.empty_table()
        group = group.sort_by("idx")
        part, (vector, moments, ranged) = chunk_of(group), state_of(state)
        found = part.features(vector, moments, ranged, state.column("index")[0].as_py() if state.num_rows else 0.0)
        group = group.slice(0 if part.first else 1)
        return pa.table([*(group.column(c) for c in carried), *(pa.array(found[n], pa.float64(), from_pandas=True) for n in C.CARRIED)], [*carried, *C.CARRIED])

    maps = followed.groupBy(*keys).applyInArrow(first_pass, f"{names}, chunk long, {_STATE}")
    states = maps.groupBy(*by).applyInArrow(scan, f"{names}, chunk long, vector array<double>, n long, mean double, square double, ranged long")
    indices = followed.groupBy(*keys).cogroup(states.groupBy(*keys)).applyInArrow(second_pass, f"{names}, chunk long, decay double, add double")
    states = states.join(indices.groupBy(*by).applyInArrow(scan_index, f"{names}, chunk long, index double"), keys)
    carried = [c for c in cut.columns if c not in ("chunk", "own", *C.CARRIED)]
    schema = T.StructType([*(cut.schema[c] for c in carried), *(T.StructField(n, T.DoubleType()) for n in C.CARRIED)])
    out_schema = to_arrow_schema(schema)
    return cut.groupBy(*keys).cogroup(states.groupBy(*keys)).applyInArrow(last_pass, schema)


def _recursions_at_once(df: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """`recursions` of series that are one chunk each."""
    schema = T.StructType([*df.schema.fields, T.StructField("rows", T.LongType()), T.StructField("idx", T.LongType()), *(T.StructField(n, T.DoubleType()) for n in C.CARRIED)])

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("time")
        found = C.Chunk(0, *(_numbers(group, c) for c in ("high", "low", "close"))).features(np.zeros(len(C.LINEAR)), C.Moments(), None, 0.0)
        counts = {"rows": pa.array(np.full(group.num_rows, group.num_rows)), "idx": pa.array(np.arange(group.num_rows))}
        return pa.table([*group.columns, *counts.values(), *(pa.array(found[n], pa.float64(), from_pandas=True) for n in C.CARRIED)], [*group.column_names, *counts, *C.CARRIED])

    return df.groupBy(*by).applyInArrow(run, schema)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy(zero_copy_only=False).astype(float)


def series_features(bars: DataFrame, rows: int = ROWS_A_CHUNK, funding: bool = False) -> DataFrame:
    """(symbol, time, features) that bars give: their own, those of the funding known at each (columns _rate and
    _interest), and those against the first other symbol.

    A series is worked on in one numpy pass, with the other symbol's bars beside it, in chunks of `rows` rows of both.  The
    2 * HALO rows before lead a chunk: look-backs are at most 300 rows, and older values weigh below 1e-15 in every
    recursion (`recursions` carries them exactly).  Values that are missing or not numbers come back as null.
    """
    bars = kept(bars.select("symbol", "time", *_NUMBERS[:6], *(_NUMBERS[6:] if funding else ())), "bars")  # read several times below
    missing = [F.lit(None).cast("double").alias(c) for c in ("_rate", "_interest")]
    own = bars.select("symbol", "time", *[F.col(c).cast("double").alias(c) for c in _NUMBERS[:6]], *(_NUMBERS[6:] if funding else missing), F.lit(BAR).alias("_kind"))
    beside = other_symbols(bars).withColumnsRenamed({"symbol": "_mine", "other": "symbol"})
    others = bars.select("symbol", "time", F.col("close").cast("double").alias("close")).join(beside, "symbol").select(F.col("_mine").alias("symbol"), "time", "close", F.lit(OTHER).alias("_kind"))
    both = own.unionByName(others, allowMissingColumns=True)
    whole = 2 * longest(bars) <= rows
    rows = both.withColumns({"chunk": F.lit(0), "own": F.lit(True)}) if whole else in_chunks(numbered(both, tie=("_kind",), once=False), 2 * HALO, rows)
    by = ["symbol", "chunk"]
    names = (*FROM_BARS, *(FROM_FUNDING if funding else ()), *FROM_OTHER)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("time")
        bar = group.filter(pc.equal(group.column("_kind"), BAR))
        other = group.filter(pc.equal(group.column("_kind"), OTHER))
        time, other_time = (t.column("time").to_numpy() for t in (bar, other))
        found = bar_arrays(*(_numbers(bar, c) for c in _NUMBERS[:6])) | other_arrays(time, _numbers(bar, "close"), other_time, _numbers(other, "close"))
        if funding:
            found |= funding_arrays(*(_numbers(bar, c) for c in _NUMBERS[6:]))
        own = pa.table({"symbol": bar.column("symbol"), "time": bar.column("time")} | {n: pa.array(found[n], pa.float64(), from_pandas=True) for n in names})
        return own.filter(bar.column("own"))

    return rows.groupBy(*by).applyInArrow(run, ", ".join([f"symbol {kinds['symbol']}", f"time {kinds['time']}", *(f"{n} double" for n in names)]))


def book_bars(book: DataFrame, bar: int = BAR_SECONDS) -> DataFrame:
    """What each bar of `bar` seconds keeps of its snapshots: states weighted by dwell, order flow within the bar, the best
    quotes of its first and last snapshot.

    Snapshots are grouped by symbol and day (whole bars), so that the dwell of each is known within its group.
    """
    sizes = lambda c: F.slice(F.col(c), 1, LEVELS).alias(c)
    at = lambda side, i: F.get(f"{side}_px", F.lit(i)).cast("double").alias(f"{side[0]}{i}")
    length = -(-DAY // bar) * bar
    rows = book.select("symbol", "time", F.floor(F.unix_seconds("time") / F.lit(length)).cast("long").alias("_day"), *[at(side, i) for side in ("bid", "ask") for i in PRICED], sizes("bid_sz"), sizes("ask_sz"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    numbers = ("ofi", *STATES, *(f"{end}_{k}" for end in ("first", "last") for k in BEST))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("time")
        found = bar_sums(group.column("time").cast(pa.timestamp("us", "UTC")).cast(pa.int64()).to_numpy(), levels(group.column("bid_sz")), levels(group.column("ask_sz")), {f"{s}{i}": quote(group.column(f"{s}{i}")) for s in "ba" for i in PRICED}, bar * 1_000_000)
        time = pa.array(found["time"]).cast(pa.timestamp("us")).cast(group.schema.field("time").type)
        return pa.table([group.column("symbol").take(pa.array(np.zeros(len(time), int))), time, *(pa.array(found[n]) for n in numbers)], ["symbol", "time", *numbers])

    return rows.groupBy("symbol", "_day").applyInArrow(run, ", ".join([f"symbol {kinds['symbol']}", f"time {kinds['time']}", *(f"{n} double" for n in numbers)]))


def book_features(book: DataFrame, bar: int = BAR_SECONDS, rows: int = ROWS_A_CHUNK) -> DataFrame:
    """Per symbol and bar of `bar` seconds: states weighted by dwell (a missing state counts as 0), summed order flow against
    the snapshot before (of the symbol, in whichever bar; 0 for the first), spread statistics on bars that have snapshots.

    Prices past the end of a side are missing, sizes 0.  Snapshots are read once, by symbol and day; the step from one bar
    to the next and the rolling statistics look at one row a bar, in chunks led by the bars before.
    """
    cut = bounded(kept(book_bars(book, bar), "book-bars"), 60, rows)
    s = Series(("symbol", "chunk"))
    was = {k: s.lag(f"last_{k}") for k in BEST}
    gain = lambda on, size: F.when(on, size).otherwise(0.0)
    step = lambda price, size, better, worse: gain(better(F.col(f"first_{price}"), was[price]), F.col(f"first_{size}")) - gain(worse(F.col(f"first_{price}"), was[price]), was[size])
    at_least = lambda a, b: ~F.isnan(a) & ~F.isnan(b) & (a >= b)
    at_most = lambda a, b: ~F.isnan(a) & ~F.isnan(b) & (a <= b)
    flow = step("b0", "bs", at_least, at_most) - step("a0", "as", at_most, at_least)
    df = cut.withColumns({"ofi": F.col("ofi") + flow, "spread_z_60": s.zscore("spread_bps", 60), "spread_vol_30": s.std("spread_bps", 30)})
    return df.filter("own").select("symbol", "time", *BOOK_FEATURES)


def funding_features(bars: DataFrame, funding: DataFrame, tie: tuple[str, ...] = ()) -> DataFrame:
    """(symbol, time, 4 features): the funding known at each bar and its statistics on the bar grid."""
    s = Series()
    df = asof_join(bars.select("symbol", "time"), funding, ["funding_rate", "open_interest"], tie=tie)
    df = df.withColumns({"funding_z_60": s.zscore("funding_rate", 60), "oi_log": F.log1p("open_interest"), "oi_change": flog(fdiv("open_interest", s.lag("open_interest")))})
    return df.select("symbol", "time", *FUNDING_FEATURES)


def other_symbols(df: DataFrame) -> DataFrame:
    """(symbol, other): the first other symbol of each; one row a symbol."""
    w = Window.orderBy("symbol")
    names = df.select("symbol").distinct().withColumns({"first": F.first("symbol").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "second": F.nth_value("symbol", 2).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    return names.select("symbol", F.when(F.col("symbol") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("other")).filter("other is not null")


def cross_features(rets: DataFrame) -> DataFrame:
    """(symbol, time, 3 features) from (symbol, time, ret_1), on the bars that both symbols have."""
    mine = rets.select("symbol", "time", F.col("ret_1").alias("_x")).join(other_symbols(rets), "symbol")
    theirs = rets.select(F.col("symbol").alias("other"), "time", F.col("ret_1").alias("_y"))
    df, s = mine.join(theirs, ["other", "time"]), Series()
    both = F.col("_x") * F.col("_y")
    beta = fdiv(s.full(60, both, F.covar_pop("_x", "_y")), s.full(60, "_y", F.var_pop("_y")))
    return df.withColumns({"cross_corr_60": s.corr("_x", "_y", 60), "cross_beta_60": beta, "cross_ret_spread": F.col("_x") - F.col("_y")}).select("symbol", "time", *CROSS_FEATURES)


def compute_features(bars: DataFrame, book: DataFrame | None = None, funding: DataFrame | None = None, rows: int = ROWS_A_CHUNK, finite: bool = False, seconds: int = BAR_SECONDS, funding_tie: tuple[str, ...] = ()) -> DataFrame:
    """[symbol, time, 58 features] for all symbols in one plan.

    Of funding rows of one time the last by `funding_tie` counts.  `seconds` is the length of the bars, into which book snapshots fall.  Missing inputs give null columns.  With `finite`, infinities become null too.
    """
    if funding is not None:
        known = funding.select("symbol", "time", *funding_tie, F.col("funding_rate").alias("_rate"), F.col("open_interest").alias("_interest"))
        bars = asof_join(bars, known, ["_rate", "_interest"], tie=funding_tie)
    df = series_features(bars, rows, funding is not None).withColumns(day_cycle())
    if book is not None:
        df = df.join(book_features(book, seconds, rows), ["symbol", "time"], "left")
    df = df.withColumns({n: F.lit(None).cast("double") for n in FEATURE_NAMES if n not in df.columns})
    return df.select("symbol", "time", *[finite_or_null(n).alias(n) if finite else F.col(n) for n in FEATURE_NAMES])

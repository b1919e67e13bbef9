"""Operators that carry state over micro-batches: CUSUM events, and features of the bars that late rows touch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.series import latest
from ..operators.features import compute_features, other_symbols
from ..operators.labels import Cusum
from ..schemas import BAR_SECONDS, WARMUP_BARS
from ..sources.tables import scan, write_keyed


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    cusum = Cusum()
    if state.exists:
        cusum.up, cusum.down = state.get
    rows = pd.concat(list(batches)).sort_values("time")
    on = [cusum.step(m, b) for m, b in zip(rows["move"].astype(float), rows["bar"].astype(float), strict=True)]
    state.update((cusum.up, cusum.down))
    yield rows.loc[on, ["symbol", "time"]]


def cusum_stream(stream: DataFrame) -> DataFrame:
    """(symbol, time) of CUSUM events in a stream of (symbol, time, move, bar) whose rows come in time order by symbol.

    The state of a symbol is two numbers; a micro-batch's rows of a symbol are taken in time order.
    """
    return stream.groupBy("symbol").applyInPandasWithState(_step, "symbol string, time timestamp", "up double, down double", "append", GroupStateTimeout.NoTimeout)


def incremental_features(stream: DataFrame, root: str, checkpoint: str, trigger: dict | None = None, warm_up: int = WARMUP_BARS, gaps: int = 3) -> StreamingQuery:
    """Keep bar_features up to date with a stream of bars (row windows do not work on streams).

    Each micro-batch is upserted, the later of repeated rows counting, and features are computed again for each symbol from
    the earliest row on that is new for it or for the symbol it is compared with, with `warm_up` bars before; only those rows
    are written.  The bars before are looked for in `gaps` times their usual time.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumn("_seq", F.monotonically_increasing_id()).persist()
        try:
            firsts = {r["symbol"]: r["first"] for r in batch.groupBy("symbol").agg(F.min("time").alias("first")).collect()}  # a row a symbol
            if not firsts:
                return
            write_keyed(batch, root, "ohlcv_bars")
        finally:
            batch.unpersist()
        spark, since = stream.sparkSession, min(firsts.values()) - pd.Timedelta(seconds=gaps * warm_up * BAR_SECONDS)
        bars, book, funding = (scan(spark, root, t, since=since) for t in ("ohlcv_bars", "orderbook_snapshots", "funding_oi"))
        beside = {r["symbol"]: r["other"] for r in other_symbols(bars).collect()}  # a row a symbol
        began, earliest = F.lit(None).cast("timestamp"), F.lit(min(firsts.values()))
        for symbol in {*firsts, *(s for s, other in beside.items() if other in firsts)}:
            began = F.when(F.col("symbol") == symbol, F.lit(min(firsts[s] for s in (symbol, beside.get(symbol)) if s in firsts))).otherwise(began)
        known = bars.filter(F.col("time") >= F.coalesce(began, earliest)).unionByName(latest(bars.filter(F.col("time") < F.coalesce(began, earliest)), n=warm_up))
        found = compute_features(known, book, funding)
        write_keyed(found.filter(F.col("time") >= began), root, "bar_features")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

"""Structured Streaming ingest: decode by channel, upsert each micro-batch, keep the query alive."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..sources.decode import books, candles, contexts
from ..sources.tables import write_keyed


def decode_batch(messages: DataFrame, received: Column, value: str = "value") -> dict[str, DataFrame]:
    """Table rows of a batch of messages, all channels."""
    return {"ohlcv_bars": candles(messages, value), "orderbook_snapshots": books(messages, value), "funding_oi": contexts(messages, received, value)}


@dataclass
class Written:
    """Rows written and dropped so far, by table."""

    written: Counter[str] = field(default_factory=Counter)
    dropped: Counter[str] = field(default_factory=Counter)


def ingest(stream: DataFrame, root: str, checkpoint: str, value: str = "value", received: str | None = None, trigger: dict | None = None, arrival: str | None = None, counts: Written | None = None, drop_failed: bool = False) -> StreamingQuery:
    """Start the ingest of a stream of messages.

    Every micro-batch is decoded once and written by key, so a batch that is run again after a failure changes nothing:
    with the checkpoint this gives each row exactly one effect.  Of rows of one key in a batch the later counts: by the
    column `arrival` (an offset, say) if there is one, else by their place in the files.  `counts` is added to after each
    write; with `drop_failed`, rows of a failed write are counted as dropped and the stream goes on.
    """
    counts = counts or Written()

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.sort(arrival) if arrival else batch
        batch = batch.withColumn("_at", F.col(received) if received else F.current_timestamp()).persist()
        try:
            for table, rows in decode_batch(batch, F.col("_at"), value).items():
                n = rows.count()
                if not n:
                    continue
                try:
                    write_keyed(rows.withColumn("_seq", F.monotonically_increasing_id()), root, table)
                    counts.written[table] += n
                except Exception:
                    if not drop_failed:
                        raise
                    counts.dropped[table] += n
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def bars_of_ticks(stream: DataFrame, bar: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """OHLCV bars of a stream of ticks (symbol, time, price, size, seq); closed bars are emitted once the watermark passes them."""
    order = F.struct("time", "seq")
    return stream.withWatermark("time", late).groupBy("symbol", F.window("time", bar)).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("size").alias("volume"), F.count(F.lit(1)).cast("int").alias("trades")
    ).select("symbol", F.col("window.start").alias("time"), "open", "high", "low", "close", "volume", "trades")


def first_snapshots(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The first row of each (symbol, time) within the watermark."""
    return stream.withWatermark("time", late).dropDuplicatesWithinWatermark(["symbol", "time"])


@dataclass
class Supervision:
    """When and how a query is started again (fixed values)."""

    stale_after: float = 90.0
    check_every: float = 15.0
    retries: int | None = None
    backoff_first: float = 1.0
    backoff_factor: float = 2.0
    backoff_most: float = 60.0


def should_restart(alive: bool, idle: float, stale_after: float) -> bool:
    return not alive or idle > stale_after


def backoff(attempt: int, first: float = 1.0, factor: float = 2.0, most: float = 60.0) -> float:
    """Seconds before the given attempt (1 is the first)."""
    return min(first * factor ** max(attempt - 1, 0), most)


class Freshness(StreamingQueryListener):
    """Seconds since each query last took in rows, told by Spark's progress events.

    Every batch counts, also those between two looks; a query that starts counts as fresh, one that ends is forgotten.
    """

    def __init__(self, clock: Callable[[], float] = time.monotonic) -> None:
        self.clock, self.last = clock, {}

    def onQueryStarted(self, event) -> None:
        self.last[str(event.runId)] = self.clock()

    def onQueryProgress(self, event) -> None:
        if event.progress.numInputRows:
            self.last[str(event.progress.runId)] = self.clock()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.last.pop(str(event.runId), None)

    def idle(self, query: StreamingQuery) -> float:
        return self.clock() - self.last.setdefault(str(query.runId), self.clock())


def supervise(start: Callable[[], StreamingQuery], stop: Callable[[], bool], config: Supervision | None = None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep, spark: SparkSession | None = None) -> int:
    """Keep a query running until `stop`; returns the number of restarts.  Liveness comes from a listener on the session's queries."""
    config, attempt, restarts, fresh = config or Supervision(), 0, 0, Freshness(clock)
    streams = (spark or SparkSession.getActiveSession()).streams if spark or SparkSession.getActiveSession() else None
    if streams is not None:
        streams.addListener(fresh)
    query = start()
    try:
        while not stop():
            sleep(config.check_every)
            if not should_restart(query.isActive, fresh.idle(query), config.stale_after):
                attempt = 0
                continue
            attempt += 1
            if config.retries is not None and attempt > config.retries:
                raise RuntimeError("the stream did not come back")
            if query.isActive:
                query.stop()
            sleep(backoff(attempt, config.backoff_first, config.backoff_factor, config.backoff_most))
            query, restarts = start(), restarts + 1
    finally:
        if query.isActive:
            query.stop()
        if streams is not None:
            streams.removeListener(fresh)
    return restarts

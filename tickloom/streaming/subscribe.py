"""Subscriptions as a replayable stream: a journal of received messages, and a Python data source that reads it by offsets."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Messages buffered before they are written, and seconds after which they are written anyway (fixed values).
FLUSH_ROWS, FLUSH_SECONDS = 2000, 1.0


class Journal:
    """Messages by channel and symbol in numbered segments, in a folder that driver and executors share.

    A segment is named by the number of its first message, holds at most `rows` of them, and appears whole by a rename, so a
    reader never sees a part of one and a message keeps its number for good.
    """

    def __init__(self, path: str, rows: int = FLUSH_ROWS, seconds: float = FLUSH_SECONDS, clock: Callable[[], float] = time.time) -> None:
        self.path, self.rows, self.seconds, self.clock = path, rows, seconds, clock
        self.waiting: dict[tuple[str, str], list[str]] = {}
        self.next: dict[tuple[str, str], int] = {}
        self.flushed = clock()

    def add(self, channel: str, symbol: str, text: str) -> None:
        """Takes a message in; a full buffer, or one that has waited long enough, is written."""
        lines = self.waiting.setdefault((channel, symbol), [])
        lines.append(json.dumps([int(self.clock() * 1000), text]))
        if len(lines) >= self.rows:
            self._write((channel, symbol))
        elif self.clock() - self.flushed >= self.seconds:
            self.flush()

    def flush(self) -> None:
        for key in list(self.waiting):
            self._write(key)
        self.flushed = self.clock()

    def _write(self, key: tuple[str, str]) -> None:
        lines = self.waiting.pop(key, None)
        if not lines:
            return
        folder = os.path.join(self.path, *key)
        os.makedirs(folder, exist_ok=True)
        first = self.next.get(key, available(self.path, *key))
        part = os.path.join(folder, f".{first:020d}")
        with open(part, "w", encoding="utf-8") as f:
            f.write("\n".join(lines) + "\n")
            f.flush()
            os.fsync(f.fileno())
        os.rename(part, os.path.join(folder, f"{first:020d}.jsonl"))
        self.next[key] = first + len(lines)


def segments(path: str, channel: str, symbol: str) -> list[int]:
    """Numbers of the first messages of the segments, rising."""
    try:
        names = os.listdir(os.path.join(path, channel, symbol))
    except FileNotFoundError:
        return []
    return sorted(int(n.removesuffix(".jsonl")) for n in names if n.endswith(".jsonl"))


def _lines(path: str, channel: str, symbol: str, first: int) -> list[str]:
    with open(os.path.join(path, channel, symbol, f"{first:020d}.jsonl"), encoding="utf-8") as f:
        return f.read().splitlines()


def available(path: str, channel: str, symbol: str) -> int:
    """The number that the next message will have."""
    found = segments(path, channel, symbol)
    return found[-1] + len(_lines(path, channel, symbol, found[-1])) if found else 0


def receive(connect: Callable[[list[tuple[str, str]]], Iterable[tuple[str, str, str]]], subscriptions: list[tuple[str, str]], journal: Journal, stop: Callable[[], bool] = lambda: False) -> int:
    """Writes what `connect` gives for the subscriptions, (channel, symbol, text), to the journal until it ends; returns their number.

    Run it under `supervise` or beside it: messages taken in before a break stay, and a reconnection goes on after them.
    """
    n, wanted = 0, set(subscriptions)
    try:
        for channel, symbol, text in connect(subscriptions):
            if (channel, symbol) in wanted:
                journal.add(channel, symbol, text)
                n += 1
            if stop():
                break
    finally:
        journal.flush()
    return n


@dataclass
class Run(InputPartition):
    channel: str
    symbol: str
    start: int
    end: int

    def __init__(self, channel: str, symbol: str, start: int, end: int) -> None:
        super().__init__(None)
        self.channel, self.symbol, self.start, self.end = channel, symbol, start, end


class MarketMessages(DataSource):
    """format("market_messages"): options path, subscriptions ("channel/symbol", comma-separated), rows and reader.

    `rows` is the number of messages of a subscription that one micro-batch takes, and those of one task; `reader` names the
    query, whose last planned offsets are kept beside the journal.
    """

    @classmethod
    def name(cls) -> str:
        return "market_messages"

    def schema(self) -> str:
        return "channel string, symbol string, number long, received_ms long, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return MessageReader(dict(self.options))


class MessageReader(DataSourceStreamReader):
    """Offsets are the numbers of the next messages by subscription.

    Spark replays a batch by the offsets it has written down before, and the journal gives the same messages for them, so a
    restart neither loses nor repeats any.  Where to go on from for the next bounded batch is what was planned last: Spark
    plans every batch whose offsets it has written down, also the one it runs again after a restart.
    """

    def __init__(self, options: dict) -> None:
        self.path, self.rows = options["path"], int(options.get("rows", FLUSH_ROWS))
        self.keys = [tuple(k.split("/")) for k in options["subscriptions"].split(",")]
        self.state = os.path.join(self.path, f".planned-{options.get('reader', 'main')}.json")
        self.planned: dict[str, int] | None = None

    def initialOffset(self) -> dict:
        return {"/".join(k): 0 for k in self.keys}

    def latestOffset(self) -> dict:
        if self.planned is None:
            self.planned = {}
            if os.path.exists(self.state):
                with open(self.state, encoding="utf-8") as f:
                    self.planned = json.load(f)
        there = {"/".join(k): available(self.path, *k) for k in self.keys}
        return {k: max(min(n, self.planned.get(k, 0) + self.rows), self.planned.get(k, 0)) for k, n in there.items()}

    def partitions(self, start: dict, end: dict) -> list[Run]:
        if any(n < start.get(k, 0) for k, n in end.items()):
            raise ValueError(f"{self.state} is older than the query's checkpoint")
        was = self.planned or {}
        self.planned = {k: max(n, was.get(k, 0)) for k, n in end.items()}
        part = f"{self.state}.new"
        os.makedirs(self.path, exist_ok=True)
        with open(part, "w", encoding="utf-8") as f:
            json.dump(self.planned, f)
        os.replace(part, self.state)
        return [Run(*k, a, min(a + self.rows, end["/".join(k)])) for k in self.keys for a in range(start.get("/".join(k), 0), end.get("/".join(k), 0), self.rows)]

    def read(self, part: Run) -> Iterator[tuple]:
        found = segments(self.path, part.channel, part.symbol)
        for first, following in zip(found, [*found[1:], None], strict=True):
            if first >= part.end or (following is not None and following <= part.start):
                continue
            for number, line in enumerate(_lines(self.path, part.channel, part.symbol, first), first):
                if part.start <= number < part.end:
                    received, text = json.loads(line)
                    yield part.channel, part.symbol, number, received, text


def read_messages(spark: SparkSession, path: str, subscriptions: list[tuple[str, str]], rows: int = FLUSH_ROWS, reader: str = "main") -> DataFrame:
    """A stream of the journal's messages: channel, symbol, number, received_ms, value."""
    spark.dataSource.register(MarketMessages)
    return spark.readStream.format("market_messages").options(path=path, subscriptions=",".join("/".join(s) for s in subscriptions), rows=rows, reader=reader).load()

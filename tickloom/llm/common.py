"""What the text operators share: scratch tables and vectorised word hashing.

Word hashing works on the UTF-8 bytes of a whole Arrow batch at a time, so one
numpy call handles thousands of documents.  Hashes only nominate candidates or
name equal word sequences; 64 bits are used throughout.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()

#: Bytes of text hashed in one numpy step: bounds a task's temporary arrays.
CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.uint64(1)


def ascii_lower(col):
    """Lower-case A-Z only (not other alphabets)."""
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; only a master of one machine may go without."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tickloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors.

    `folder` is a column of which each value gets a folder, so a filter on it reads only that.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tickloom-{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(folder) if folder else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that no result reads any more; call it when all that was made of them is written."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Keys of rows to drop are broadcast up to this number, else joined by shuffle.
BROADCAST_KEYS = 500_000


def drop_rows(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of `docs` whose id and text hash are not among `keys` (doc_id, text_hash); names of `docs` may be any."""
    names = docs.columns
    keys = keys.select(F.struct(F.col("doc_id").alias("i"), F.col("text_hash").alias("t")).alias("key"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.struct(F.col(f"`{id_col}`").alias("i"), F.xxhash64(F.col(f"`{text_col}`")).alias("t")).alias("mine"))
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    kept = rows.join(keys, F.col("mine.i").eqNullSafe(F.col("key.i")) & (F.col("mine.t") == F.col("key.t")), "left_anti")
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in names])


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: close inputs give unrelated outputs."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _inverse(odd: int) -> int:
    """Inverse of an odd number modulo 2**64."""
    return pow(odd, -1, 1 << 64)


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        up = np.full(size, _BASE)
        up[0] = 1
        down = np.full(size, np.uint64(_inverse(int(_BASE))))
        down[0] = 1
        _POWERS["up"], _POWERS["down"] = np.cumprod(up), np.cumprod(down)
    return _POWERS["up"], _POWERS["down"]


def byte_class(separators: bytes) -> np.ndarray:
    """Table of 256 flags: True where a byte belongs to a word."""
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


#: Words are runs of anything but ASCII white space.
SPACE_WORDS = byte_class(bytes([0x20, *range(0x09, 0x0E)]))
#: Words are runs of ASCII letters, ASCII digits and every non-ASCII character.
ALNUM_WORDS = byte_class(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_chunks(texts: pa.Array, limit: int = CHUNK_BYTES, table: np.ndarray | None = _LOWER) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, lower-cased bytes, row offsets) of about `limit` bytes each; null is empty.

    `table` maps the bytes; with None they stay as they are.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    n = len(texts)
    if not n:
        return
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        part = data[off[a] : off[b]]
        yield a, b, part if table is None else table[part], off[a : b + 1] - off[a]
        a = b


def words_of(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte, first word of each row plus the total) of all words."""
    n = len(data)
    w = inside[data]
    first = np.zeros(n + 1, bool)
    first[off] = True
    prev = np.empty(n, bool)
    prev[:1] = False
    prev[1:] = w[:-1]
    starts = np.flatnonzero(w & (~prev | first[:n]))
    nxt = np.empty(n, bool)
    nxt[-1:] = False
    nxt[:-1] = w[1:]
    ends = np.flatnonzero(w & (~nxt | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, by differences of one prefix sum over the chunk."""
    n = len(data)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _ONE) * up[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix64(h + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of words i..i+k-1 for every i that has k words from it on (rows are not minded)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h *= np.uint64(0xC2B2AE3D27D4EB4F)
        h += words[j : j + n]
    return mix64(h)


def starts_within(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions at which k words of one row begin, their counts by row)."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    before = np.cumsum(counts) - counts
    return np.arange(len(rows)) - before[rows] + first[:-1][rows], counts

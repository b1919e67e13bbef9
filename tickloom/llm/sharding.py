"""Shards of near equal bytes that keep equal texts together: a minimax contiguous partition.

Texts fall into 2**UNIT_BITS atomic groups by their hash, in the order of its value; equal texts share a group.  Of all
capacities the smallest is searched by halving at which groups in this order, each put into the current shard while it fits
and else into the next one, need no more shards than there are; shards are cut at that capacity, each as near to the mean of
what is left as the capacity allows the rest.  A text whose
copies alone reach the mean of what is left to share out (there are fewer of them than shards) comes first in the order and
is a shard of its own, so that the others stay near equal.  All of it is DataFrame and SQL functions.

Null text counts as empty.  Repeated rows are rows of their own; equal ones may swap slots.  An empty table gives no rows,
tables with fewer groups than shards leave shards empty.  Only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Shards, bytes that a row takes beside its text, and the logarithm of the number of atomic groups (at most 16).
SHARDS, ROW_BYTES, UNIT_BITS = 24, 8, 14


def _sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("unit").agg(F.sum("size").alias("size"))


def hot_texts(rows: DataFrame, shards: int) -> list[str]:
    """Hashes of the texts that take a shard each, largest first.

    Only groups that may hold such a text are looked into: the j-th such text has at least the mean of what j groups leave.
    """
    falling = Window.orderBy(F.col("size").desc(), "key").rowsBetween(Window.unboundedPreceding, 0)  # over one row a group, then over at most `shards` rows
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    units = _sizes(rows).withColumnRenamed("unit", "key")
    units = units.withColumns({"j": F.row_number().over(Window.orderBy(F.col("size").desc(), "key")) - 1, "left": F.sum("size").over(every) - F.sum("size").over(falling) + F.col("size"), "total": F.sum("size").over(every)})
    units = units.withColumn("least", F.min(F.when(F.col("j") < shards, F.col("left") / (F.lit(shards) - F.col("j")))).over(every))
    dense = units.filter(F.col("size") >= F.col("least")).select(F.col("key").alias("unit"), "total")
    texts = rows.join(F.broadcast(dense), "unit").groupBy("hash").agg(F.sum("size").alias("size"), F.first("total").alias("total"))
    most = texts.orderBy(F.col("size").desc(), "hash").limit(shards).withColumnRenamed("hash", "key")
    most = most.withColumns({"j": F.row_number().over(Window.orderBy(F.col("size").desc(), "key")) - 1, "left": F.col("total") - F.sum("size").over(falling) + F.col("size")})
    return [r["key"] for r in most.filter((F.col("size") * (F.lit(shards) - F.col("j")) >= F.col("left")) & (F.col("j") <= shards - 2)).orderBy("j").collect()]


def needed(units: Column, capacity: Column) -> Column:
    """Shards that filling in order with the sizes of `units` needs at a capacity."""
    start = F.struct(F.lit(1).alias("n"), F.lit(0).cast("long").alias("load"))
    put = lambda s, x: F.when(s["load"] + x["size"] <= capacity, F.struct(s["n"].alias("n"), (s["load"] + x["size"]).alias("load"))).otherwise(F.struct((s["n"] + 1).alias("n"), x["size"].alias("load")))
    return F.aggregate(units, start, put, lambda s: s["n"])


def capacity_and_cuts(units: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity at which `units` (unit, size) need at most `shards` shards, and the first unit of each shard but the first."""
    # One row; each search is a job of its own with the results of the one before as literals, else the optimiser would put
    # one search inside the other and run it again for every group.
    listed = materialise(units.agg(F.sort_array(F.collect_list(F.struct("unit", "size"))).alias("u")), "shard-units")
    total, most = listed.select(F.aggregate("u", F.lit(0).cast("long"), lambda a, x: a + x["size"]), F.coalesce(F.array_max(F.transform("u", lambda x: x["size"])), F.lit(0))).first()
    mean, long = -(-total // shards), lambda n: F.lit(n).cast("long")
    # No capacity below the mean or the largest group will do; their sum does, as only a shard beyond the mean is closed.
    # lo: too small, hi: enough.
    begin = F.struct(long(max(mean, most) - 1).alias("lo"), long(mean + most).alias("hi"))
    middle = lambda r: F.floor((r["lo"] + r["hi"]) / 2).cast("long")
    halve = lambda r, _: F.when(r["hi"] - r["lo"] <= 1, r).when(needed(F.col("u"), middle(r)) <= shards, F.struct(r["lo"].alias("lo"), middle(r).alias("hi"))).otherwise(F.struct(middle(r).alias("lo"), r["hi"].alias("hi")))
    capacity = listed.select(F.aggregate(F.sequence(F.lit(1), F.lit(64)), begin, halve, lambda r: r["hi"])).first()[0]
    # Filling from the end gives the first group at which each shard may begin, so that the rest still fits.
    empty = F.struct(F.array().cast("array<int>").alias("cuts"), long(0).alias("load"), F.lit(0).alias("last"))
    back = lambda s, x: F.when(s["load"] + x["size"] <= capacity, F.struct(s["cuts"].alias("cuts"), (s["load"] + x["size"]).alias("load"), x["unit"].alias("last"))).otherwise(F.struct(F.array_append(s["cuts"], s["last"]).alias("cuts"), x["size"].alias("load"), x["unit"].alias("last")))
    earliest = listed.select(F.aggregate(F.reverse("u"), empty, back, lambda s: s["cuts"])).first()[0]
    # Within those bounds each shard ends where it is nearest to the mean of what is left.
    begin = F.struct(F.array().cast("array<int>").alias("cuts"), long(0).alias("load"), long(total).alias("left"))

    def put(s: Column, x: Column) -> Column:
        k = F.size(s["cuts"])
        after = F.lit(-1)  # where shard k + 1, counted from 0, may begin
        for j, unit in enumerate(reversed(earliest)):
            after = F.when(k == shards - 1 - len(earliest) + j, unit).otherwise(after)
        full = (s["load"] + x["size"] > capacity) | ((k < shards - 1) & (x["unit"] >= after) & ((s["load"] + x["size"] / 2) * (shards - k) > s["left"]) & (s["load"] > 0))
        more = F.struct(s["cuts"].alias("cuts"), (s["load"] + x["size"]).alias("load"), s["left"].alias("left"))
        return F.when(full, F.struct(F.array_append(s["cuts"], x["unit"]).alias("cuts"), x["size"].alias("load"), (s["left"] - s["load"]).alias("left"))).otherwise(more)

    cuts = listed.select(F.aggregate("u", begin, put, lambda s: s["cuts"])).first()[0]
    return capacity, list(cuts)


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", row_bytes: int = ROW_BYTES) -> DataFrame:
    """One row a document: doc_id, size, text_crc32, law ("bytes"), shard, slot (its place there, from 0), grown_shard (null).

    Texts are read once: what the search and the numbering need of a row is written to the shared folder.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    text, units = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"), 1 << UNIT_BITS
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text) + row_bytes).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("hash"))
    rows = rows.withColumn("unit", F.shiftright(F.conv(F.substring("hash", 1, 4), 16, 10).cast("int"), 16 - UNIT_BITS))
    rows = materialise(rows, "shard-rows")
    hot = hot_texts(rows, shards)
    # Hot texts come before all groups, as units -1, -2, ...
    unit = F.col("unit")
    for j, h in enumerate(hot):
        unit = F.when(F.col("hash") == h, F.lit(-1 - j)).otherwise(unit)
    rows = rows.withColumn("unit", unit)
    _, cuts = capacity_and_cuts(_sizes(rows.filter("unit >= 0")), shards - len(hot))
    shard = F.lit(len(hot))
    for cut in cuts:
        shard = shard + F.when(F.col("unit") >= cut, 1).otherwise(0)
    rows = rows.withColumn("shard", F.when(F.col("unit") < 0, -1 - F.col("unit")).otherwise(shard).cast("int"))
    # Places: groups larger than the mean one are numbered in parts by a hash of the id, so no task holds all copies of a text.
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counted = rows.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).select("unit", F.ceil(F.col("n") * units / F.sum("n").over(every)).cast("long").alias("parts"))
    salt = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")
    rows = rows.join(F.broadcast(counted), "unit").withColumn("part", F.pmod(salt, F.col("parts"))).drop("parts")
    upto = Window.partitionBy("shard").orderBy("unit", "part").rowsBetween(Window.unboundedPreceding, 0)
    before = rows.groupBy("shard", "unit", "part").agg(F.count(F.lit(1)).alias("n")).select("unit", "part", (F.sum("n").over(upto) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("unit", "part").orderBy("hash", "doc_id")) - 1
    placed = rows.withColumn("place", place).join(F.broadcast(before), ["unit", "part"])  # twice the number of groups at most, and hot texts
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

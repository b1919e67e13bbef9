"""Self-join of documents at a Jaccard similarity of word shingles, by signature trees; exact up to 64-bit hashes.

Documents with equal shingle sets are one class, named by a 64-bit set hash; all joins are between classes.

1. A fixed-size frequency sketch of all shingles gives a global order: rare shingles first.  Two sets at or above
   the threshold share a shingle among the first n - ceil(t * n) + 1 of each, so classes meet in the groups of those
   shingles.  Shingles that only one class has there are dropped after one shuffle; frequent ones (known from the
   sketch) skip that shuffle.
2. Two leaders of each group are checked against the others, by bitmaps and then by exact overlap, and the
   links found are joined into components.  A large group of near copies is settled here by two checks per member.
3. Groups that still span components get a signature tree: nodes hold the OR of their members' shingle bitmaps and
   their range of sizes.  A dual traversal drops node pairs of one component, of unfitting sizes, or whose bitmaps
   cannot overlap enough; pairs of classes that are left are checked exactly.  Groups above BLOCK classes are cut
   into blocks and every pair of blocks is one tree join, so no task holds more than two blocks of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import BitSet, bucket_counts
from .common import SPACE_WORDS, discard, drop_rows, gram_hashes, materialise, mix64, text_chunks, word_hashes, words_of
from .graph import components

SHINGLE, PERCENT = 5, 75
SKETCH_LOG2, ACTIVE_LOG2 = 20, 24
#: Words of 64 bits of the least and the greatest bitmap (two bits a shingle between them); children of a node; leaves of a block.
BITMAP_WORDS, MOST_WORDS, FANOUT, BLOCK = 32, 512, 8, 4096
#: Classes remembered by one task, so that copies in it are not emitted again.
SEEN = 200_000


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row, shingle): the distinct shingles of each text, by row, then hash.

    A text of fewer than SHINGLE words has its whole sequence as its one shingle; one without words has none.
    """
    for a, b, data, off in text_chunks(texts):
        starts, ends, first = words_of(data, off, SPACE_WORDS)
        h, words = word_hashes(data, starts, ends), np.diff(first)
        row = np.repeat(np.arange(b - a), np.maximum(words - SHINGLE + 1, 0))
        begin = np.cumsum(np.maximum(words - SHINGLE + 1, 0)) - np.maximum(words - SHINGLE + 1, 0)
        grams = gram_hashes(h, SHINGLE)[np.arange(len(row)) - begin[row] + first[:-1][row]] if len(row) else np.zeros(0, np.uint64)
        for n in range(1, SHINGLE):
            short = np.flatnonzero(words == n)
            if len(short):
                row = np.concatenate([row, short])
                grams = np.concatenate([grams, gram_hashes(h, n)[first[:-1][short]] ^ np.uint64(n)])
        order = np.lexsort((grams, row))
        row, grams = row[order], grams[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (grams[1:] != grams[:-1])
        yield a, b - a, row[new], grams[new]


def set_hash(row: np.ndarray, grams: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, 64-bit hash) of each row's set."""
    n = np.bincount(row, minlength=rows)
    upto = np.zeros(len(grams) + 1, np.uint64)
    np.cumsum(mix64(grams), out=upto[1:])
    ends = np.cumsum(n)
    return n, mix64(upto[ends] - upto[ends - n] + n.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)).view(np.int64)


def _classes(id_type: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, rows, row, grams in shingle_sets(batch.column(2)):
                n, sig = set_hash(row, grams, rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, rows), batch.column(1).slice(a, rows), pa.array(n, pa.int64()), pa.array(sig)], ["doc_id", "text_hash", "n", "sig"])

    return run, f"doc_id {id_type}, text_hash long, n long, sig long"


def _levels(counts: np.ndarray) -> np.ndarray:
    """0 for the buckets of rare shingles, then one more for each doubling of the count."""
    mean = counts.mean()
    base = mean + 6 * np.sqrt(mean) + 4
    return np.ceil(np.log2(np.maximum(counts / base, 1))).astype(np.uint8)


def _fresh(sigs: np.ndarray, n: np.ndarray, seen: set) -> np.ndarray:
    """Rows whose class this task has not met (or has forgotten); empty sets are no classes."""
    out = np.zeros(len(sigs), bool)
    for i, (s, k) in enumerate(zip(sigs.tolist(), n.tolist(), strict=True)):
        if k and s not in seen:
            out[i] = True
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(s)
    return out


def _prefixes(levels):
    """Entries (token, sig, n, left, hot): the first shingles of each class in the global order; `left` counts those from there on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            for _, rows, row, grams in shingle_sets(batch.column(0)):
                n, sig = set_hash(row, grams, rows)
                on = _fresh(sig, n, seen)[row]
                row, grams = row[on], grams[on]
                level = levels.value[(grams & np.uint64((1 << SKETCH_LOG2) - 1)).astype(np.int64)]
                order = np.argsort(row * 64 + level, kind="stable")
                row, grams, level = row[order], grams[order], level[order]
                size = np.bincount(row, minlength=rows)
                place = np.arange(len(row)) - (np.cumsum(size) - size)[row]
                on = place < (n - (PERCENT * n + 99) // 100 + 1)[row]
                row, left = row[on], (n[row] - place)[on]
                yield pa.RecordBatch.from_arrays([pa.array(grams[on].view(np.int64)), pa.array(sig[row]), pa.array(n[row], pa.int32()), pa.array(left, pa.int32()), pa.array(level[on] > 0)], ["token", "sig", "n", "left", "hot"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token and class, one for each class of the tokens that have more than one."""
    last, known = None, False  # the last row so far, kept back; whether a row of its token went before it
    for batch in batches:
        have = pa.Table.from_batches([batch] if last is None else [last, batch])
        token, sig = (have.column(i).to_numpy() for i in range(2))
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (sig[1:] != sig[:-1])
        have, token = have.filter(pa.array(new)), token[new]
        if not len(token):
            continue
        on = np.zeros(len(token), bool)
        on[1:] = token[1:] == token[:-1]
        on[0] = known
        last, known = have.slice(len(token) - 1).combine_chunks().to_batches()[0], bool(on[-1])
        on[:-1] |= token[1:] == token[:-1]
        on[-1] = False
        yield from have.filter(pa.array(on)).combine_chunks().to_batches()
    if known:
        yield last


#: What is read of classes: their bitmaps, or their shingles.
_COLUMNS = {"bits": {"bits": "binary"}, "tokens": {"tokens": "array<long>"}}


def _picked(wanted, kind: str):
    """(sig, n, and the bitmaps or the sorted shingles) of the classes in a broadcast bit set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            for _, rows, row, grams in shingle_sets(batch.column(0)):
                n, sig = set_hash(row, grams, rows)
                on = wanted.value.has(mix64(sig.view(np.uint64))) & _fresh(sig, n, seen)
                picked = np.flatnonzero(on)
                if kind == "bits":
                    cuts = np.searchsorted(row, np.arange(rows + 1))
                    own = [grams[cuts[i] : cuts[i + 1]] for i in picked]
                    more = [pa.array([bitmap(x).tobytes() for x in own], pa.binary())]
                else:
                    more = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n[picked])]).astype(np.int32)), pa.array(grams[on[row]].view(np.int64)))]
                yield pa.RecordBatch.from_arrays([pa.array(sig[picked]), pa.array(n[picked], pa.int32()), *more], ["sig", "n", *_COLUMNS[kind]])

    return run


def _of_classes(texts: DataFrame, sigs: DataFrame, kind: str) -> DataFrame:
    """(sig, n, bits or tokens) of the classes in the column `sig`; a fixed-size bit set picks them where texts are read."""

    def positions(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [(mix64(batch.column(0).to_numpy().view(np.uint64)) & np.uint64((1 << ACTIVE_LOG2) - 1)).astype(np.int64)]

    wanted = texts.sparkSession.sparkContext.broadcast(BitSet(bucket_counts(sigs.select("sig"), positions, ACTIVE_LOG2, top=1) > 0))
    columns = _COLUMNS[kind]
    found = texts.mapInArrow(_picked(wanted, kind), ", ".join(["sig long", "n int", *(f"{c} {k}" for c, k in columns.items())]))
    return materialise(found.groupBy("sig").agg(*[F.first(c).alias(c) for c in ("n", *columns)]), f"class-{kind}")


def bitmap(grams: np.ndarray, words: int = 0) -> np.ndarray:
    """Words of 64 bits with one bit set for each shingle: `words` of them, or about two bits a shingle."""
    if not words:
        words = min(max(BITMAP_WORDS, 1 << (len(grams) // 32).bit_length()), MOST_WORDS)
    flags = np.zeros(words * 64, np.uint8)
    flags[(grams >> np.uint64(40)).astype(np.int64) & (words * 64 - 1)] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap as it were with `words` words."""
    return np.bitwise_or.reduce(bits.reshape(-1, words)) if len(bits) > words else bits


def needed(total: np.ndarray) -> np.ndarray:
    """Least overlap of two sets of so many shingles together that meets the threshold."""
    return -((-PERCENT * total) // (100 + PERCENT))


class SignatureTree:
    """Levels of nodes, leaves first; each node has the OR of its leaves' bitmaps, and ranges of size, rest and component."""

    def __init__(self, n: np.ndarray, left: np.ndarray, bits: np.ndarray, comp: np.ndarray) -> None:
        slack = n - np.bitwise_count(bits).sum(1)
        self.levels = [(bits, n, n, left, slack, comp, comp)]
        while len(self.levels[-1][0]) > 1:
            b, lo, hi, rest, s, c, d = self.levels[-1]
            at = np.arange(0, len(b), FANOUT)
            most = np.maximum.reduceat
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(lo, at), most(hi, at), most(rest, at), most(s, at), np.minimum.reduceat(c, at), most(d, at)))


def tree_pairs(n: np.ndarray, left: np.ndarray, bits: np.ndarray, comp: np.ndarray, apart: tuple[np.ndarray, ...] = (), budget: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of different components that may meet the threshold; leaves should come sorted by component.

    Only pairs that differ in every array of `apart`.  `budget` bounds the node pairs expanded at a time.
    """
    tree = SignatureTree(n, left, bits, comp).levels
    todo = [(len(tree) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        level, u, v = todo.pop()
        b, lo, hi, rest, slack, c, d = tree[level]
        on = ~((c[u] == d[u]) & (c[u] == d[v]) & (c[v] == d[v]))
        on &= (100 * hi[u] >= PERCENT * lo[v]) & (100 * hi[v] >= PERCENT * lo[u]) & (np.minimum(rest[u], rest[v]) >= needed(lo[u] + lo[v]))
        if level == 0:
            on &= u < v
            for x in apart:
                on &= x[u] != x[v]
        u, v = u[on], v[on]
        both = np.bitwise_count(b[u] & b[v]).sum(1)
        on = both + np.minimum(slack[u], slack[v]) >= needed(lo[u] + lo[v])
        u, v = u[on], v[on]
        if level == 0:
            if len(u):
                yield u, v
            continue
        size = len(tree[level - 1][0])
        for k in range(0, len(u), budget // FANOUT**2):
            p, q = u[k : k + budget // FANOUT**2], v[k : k + budget // FANOUT**2]
            cu = (p[:, None] * FANOUT + np.arange(FANOUT))[:, :, None].repeat(FANOUT, 2).ravel()
            cv = (q[:, None] * FANOUT + np.arange(FANOUT))[:, None, :].repeat(FANOUT, 1).ravel()
            ok = (cu < size) & (cv < size) & (cu <= cv)
            todo.append((level - 1, cu[ok], cv[ok]))


def group_pairs(n: np.ndarray, left: np.ndarray, bits: list[bytes], comp: np.ndarray, apart: tuple[np.ndarray, ...] = ()) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """tree_pairs of leaves with bitmaps of several widths: a tree for each width, and one across each width and the next.

    Sets that can meet the threshold differ by less than a factor of two in size, so no other widths need to meet.
    """
    width = np.array([len(x) // 8 for x in bits])
    for w in np.unique(width).tolist():
        own, both = np.flatnonzero(width == w), np.flatnonzero((width == w) | (width == 2 * w))
        for at, more in ((own, ()), *([(both, (width,))] if len(both) > len(own) else [])):
            if len(at) > 1:
                whole = np.stack([fold(np.frombuffer(bits[i], np.uint64), w) for i in at])
                for u, v in tree_pairs(n[at], left[at], whole, comp[at], tuple(x[at] for x in (*apart, *more))):
                    yield at[u], at[v]


def _tree_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of each group in rows sorted by (token, i, j); two blocks of a group meet only across."""

    def pairs(group: pa.Table) -> pa.RecordBatch | None:
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        comp, n = group.column("comp").to_numpy(), group.column("n").to_numpy().astype(np.int64)
        order = np.lexsort((n, comp))
        sig, block, left = (group.column(k).to_numpy()[order] for k in ("sig", "block", "left"))
        bits = group.column("bits").to_pylist()
        found = list(group_pairs(n[order], left.astype(np.int64), [bits[k] for k in order], comp[order], () if i == j else (block,)))
        if not found:
            return None
        u, v = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(sig[u], sig[v])), pa.array(np.maximum(sig[u], sig[v]))], ["a", "b"])

    rest = None
    for batch in batches:
        have = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        key = [have.column(k).to_numpy() for k in ("token", "i", "j")]
        new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
        cuts = [0, *new.tolist()]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if (got := pairs(have.slice(a, b - a))) is not None:
                yield got
        rest = have.slice(cuts[-1])
    if rest is not None and len(rest) and (got := pairs(rest)) is not None:
        yield got


def _may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, n_a, bits_a, n_b, bits_b), the pairs whose bitmaps leave room for the overlap needed."""
    for batch in batches:
        n, m = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 4))
        most = np.minimum(n, m)
        for i, (x, y) in enumerate(zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True)):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            x, y = fold(x, len(y)), fold(y, len(x))
            both = int(np.bitwise_count(x & y).sum())
            most[i] = min(n[i] - int(np.bitwise_count(x).sum()) + both, m[i] - int(np.bitwise_count(y).sum()) + both)
        yield batch.select([0, 1]).filter(pa.array(most >= needed(n + m)))


def _both_sides(pairs: DataFrame, classes: DataFrame, kind: str) -> DataFrame:
    side = lambda k: classes.select(F.col("sig").alias(k), F.col("n").alias(f"n_{k}"), F.col(kind).alias(f"x_{k}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "x_a", "n_b", "x_b")


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b), written, whose exact overlap meets the threshold; shingles are read only for the classes in pairs."""
    sets = _of_classes(texts, pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct(), "tokens")
    common = F.size(F.array_intersect("x_a", "x_b")).cast("long")
    found = _both_sides(pairs, sets, "tokens").filter(common * (100 + PERCENT) >= (F.col("n_a") + F.col("n_b")).cast("long") * PERCENT).select("a", "b")
    found = materialise(found, "links")
    discard(sets)
    return found


def similar_classes(texts: DataFrame) -> DataFrame:
    """(node, label): shingle-set classes that are linked with others, by component; `texts` has the one column text."""
    spark = texts.sparkSession
    mask = np.uint64((1 << SKETCH_LOG2) - 1)

    def positions(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        return ((g & mask).astype(np.int64) for _, _, _, g in shingle_sets(batch.column(0)))

    levels = spark.sparkContext.broadcast(_levels(bucket_counts(texts, positions, SKETCH_LOG2, top=1 << 31)))
    entries = texts.mapInArrow(_prefixes(levels), "token long, sig long, n int, left int, hot boolean")
    rare = entries.filter("not hot").drop("hot").repartition("token").sortWithinPartitions("token", "sig").mapInArrow(_shared, "token long, sig long, n int, left int")
    frequent = entries.filter("hot").drop("hot")
    groups = materialise(rare.unionByName(frequent), "groups")

    bitmaps = _of_classes(texts, groups.select("sig").distinct(), "bits")

    # Each group's leaders, the classes of least and greatest hash, against the others: a class of typical content leads,
    # not the shortest.  At the first shingle that two classes share they share at most what either has from there on, so
    # a pair for which that is too little is either settled in an earlier group or apart.
    member = F.struct("sig", "n", "left")
    leaders = materialise(groups.groupBy("token").agg(F.min(member).alias("lo"), F.max(member).alias("hi")), "leaders")
    stars = groups.join(leaders, "token").select("sig", "n", "left", F.explode(F.array("lo", "hi")).alias("lead"))
    fits = (F.col("lead.n") * 100 >= F.col("n") * PERCENT) & (F.col("n") * 100 >= F.col("lead.n") * PERCENT)
    room = F.least("left", "lead.left").cast("long") * (100 + PERCENT) >= (F.col("n") + F.col("lead.n")).cast("long") * PERCENT
    stars = stars.filter((F.col("sig") != F.col("lead.sig")) & fits & room)
    stars = stars.select(F.least("lead.sig", "sig").alias("a"), F.greatest("lead.sig", "sig").alias("b")).distinct()
    stars = materialise(_both_sides(stars, bitmaps, "bits").mapInArrow(_may_link, "a long, b long"), "star-pairs")
    links = _linked(stars, texts)
    labels = components(links, "stars")
    discard(stars, links)

    # Groups that still span components, without their leaders (those are settled).
    marked = groups.join(labels, groups["sig"] == labels["node"], "left").select("token", "sig", "n", "left", F.coalesce("label", "sig").alias("comp"))
    marked = materialise(marked.join(leaders, "token").filter("sig <> lo.sig and sig <> hi.sig").drop("lo", "hi"), "marked")
    open_ = materialise(marked.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("g")).filter("x <> y").select("token", F.ceil(F.col("g") / BLOCK).cast("int").alias("blocks")), "open")
    cells = marked.join(open_, "token").withColumn("block", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"))
    cells = cells.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    cells = cells.select("token", "i", "j", "block", "sig", "n", "left", "comp").join(bitmaps.select("sig", "bits"), "sig")
    pairs = materialise(cells.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(_tree_join, "a long, b long").distinct(), "tree-pairs")
    discard(groups, leaders, marked, open_, bitmaps)
    if not pairs.isEmpty():
        more, first = _linked(pairs, texts), labels
        labels = components(more.unionByName(first.select(F.col("node").alias("a"), F.col("label").alias("b"))), "joined")
        discard(more, first)
    discard(pairs)
    return labels


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, component_id, group_size.

    Words are runs of anything but ASCII white space, A-Z in lower case.  component_id is the least id that links
    reach (null ids only where there is no other).  Null and empty texts have no shingles and are linked with nothing;
    equal texts are linked; other columns are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    run, schema = _classes(id_type)
    text = F.col(f"`{text_col}`")
    rows = materialise(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(run, schema), "classes")
    labels = similar_classes(docs.select(text.alias("text")))
    classes = rows.filter("n > 0").groupBy("sig").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("members"))
    classes = classes.join(labels, classes["sig"] == labels["node"], "left").filter("members > 1 or label is not null").select("sig", "least_id", "members", F.coalesce("label", "sig").alias("label"))
    classes = materialise(classes, "class-labels")
    groups = materialise(classes.groupBy("label").agg(F.min("least_id").alias("component_id"), F.sum("members").alias("group_size")), "class-groups")
    named = materialise(classes.select("sig", "label").join(groups, "label").select("sig", "component_id", "group_size"), "class-names")
    discard(labels, classes, groups)
    one = F.lit(1).cast("long")
    linked = rows.filter("n > 0").join(named, "sig", "left").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("group_size", one).alias("group_size"))
    empty = rows.filter("n = 0").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), one.alias("group_size"))
    return linked.unionByName(empty)


def keep_one_of_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, whole: of each group of linked documents the one with the least id (then text hash) stays.

    Rows equal in id and text share the decision.
    """
    found = materialise(similar_documents(docs, id_col, text_col).filter("group_size > 1").select("doc_id", "text_hash", "component_id"), "similar")
    best = materialise(found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("best")), "similar-best")
    drop = found.join(best, found["component_id"].eqNullSafe(best["component_id"])).filter(~(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash"))))
    drop = materialise(drop.select("doc_id", "text_hash").distinct(), "similar-drop")
    discard(found, best)
    return drop_rows(docs, drop, id_col, text_col)

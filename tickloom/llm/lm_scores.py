"""Language-model scores of texts by a small causal self-attention model, trained in numpy on subword ids.

One pass turns texts into subword ids and counts words and ids of the whole training part; only ids are written (a word is
the run of ids from one that begins with a space to the next), so no text is read twice.  The model is one head of causal attention with learned weights by distance, a path from
the id before, and a residual; an id's probability is that of its group times that of its place in the group, both by
softmax, and rare ids share a place by their counts.  It is trained on every id of every training document, each once,
in a few rounds that grow: in a round every task takes steps over its documents of the round, and the mean of the tasks'
models, weighted by windows, goes on.  Scoring cuts a text into windows of LENGTH ids that overlap by CONTEXT; each id is
a target once and sees at least CONTEXT ids before it (or the start).  A word's probability is the product of those of its
ids, mixed with the word's share of all training tokens at the weight SHARE.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_WORDS, discard, materialise, text_chunks, word_hashes, words_of
from .labelled import remainder

FOLDS, HELD_OUT = 10, 0
SMOOTH = 0.1
LENGTH, CONTEXT, WIDTH = 32, 8, 16
#: Groups of ids, places in a group, and places that one id has for itself; group and place together number the inputs.
GROUPS, PLACES, OWN = 32, 32, 24
INPUTS = GROUPS * PLACES
#: Weight of the word's share of all training tokens.
SHARE = 0.2
#: Last of the 64 parts of the training documents in each round, the rounds' rates, and model sums a round that the driver gets.
PARTS, ROUNDS, RATES, SUMS = 64, (1, 4, 16, 64), (1e-2, 1e-2, 8e-3, 4e-3), 8
#: Windows of a step: the least up to FEW windows seen by a task, from there on with their square; steps over which the
#: model is averaged.
LEAST_BATCH, MOST_BATCH, FEW, AVERAGED = 16, 512, 1 << 13, 50
#: Bytes of one untouched array that a task makes and frees, see `keep_pages`.
HELD_BYTES = 30 << 20
#: Windows in one block of the attention (their arrays stay in a core's cache), and ids handled at a time.
BLOCK, IDS_AT_ONCE = 64, 1 << 19
SEED = 11
#: Counts of at most this many frequent words are broadcast (12 bytes each); all others are joined by shuffle.
HEAD_WORDS = 1 << 19
#: Words whose ids one task keeps.
KEPT = 300_000
#: Stands for the end of a text among the word hashes, and for nothing among ids.
END_WORD, NOTHING = -1, 65535
WORDS, IDS = 0, 1


class Subwords:
    """Ids of words under a byte-level BPE, each word with the space before it; so a text has one id sequence."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.code = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 2
        if self.size >= NOTHING:
            raise ValueError("ids must fit 16 bits")
        self.end = self.size - 1
        self.tokens = [b""] * self.size
        for token, i in ranks.items():
            self.tokens[i] = token
        #: Ids that begin with a space: the first of each word, and no other.
        self.first = np.array([t[:1] == b" " for t in self.tokens])
        self._forget()

    def _forget(self) -> None:
        #: Hashes of the known words in order, and the number of each.
        self.known, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.begin = np.zeros(0, np.uint16), np.zeros(1, np.int64)

    def ids_of(self, data: bytes, starts: np.ndarray, ends: np.ndarray, unique: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, ids of each word); `unique`, `at`, `which` as np.unique gives them for the words' hashes."""
        if len(self.known) > KEPT:
            self._forget()
        to = np.searchsorted(self.known, unique)
        there = to < len(self.known)
        there[there] = self.known[to[there]] == unique[there]
        new = np.flatnonzero(~there)
        if len(new):
            words = [data[starts[i] : ends[i]] for i in at[new].tolist()]
            ids = np.array(self.code.encode_ordinary((b" " + b" ".join(words)).decode("utf-8", "replace")), np.uint16)
            cuts = np.append(np.flatnonzero(self.first[ids]), len(ids))
            if len(cuts) != len(words) + 1:  # the pattern ran over a space (beside no-break spaces, say): one by one
                apart = [self.code.encode_ordinary(" " + w.decode("utf-8", "replace")) for w in words]
                ids, cuts = np.array([i for x in apart for i in x], np.uint16), np.cumsum([0, *map(len, apart)])
            self.number = np.insert(self.number, to[new], np.arange(len(new)) + len(self.known))
            self.known = np.insert(self.known, to[new], unique[new])
            to = np.searchsorted(self.known, unique)
            self.begin = np.concatenate([self.begin, cuts[1:] + len(self.flat)])
            self.flat = np.concatenate([self.flat, ids])
        place = self.number[to]
        begin = self.begin[place][which]
        n = self.begin[place + 1][which] - begin
        return self.flat[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - begin, n)], n


@cache
def _subwords(path: str, pattern: str) -> Subwords:
    return Subwords(path, pattern)


_ENCODED = "rid long, doc_id {id}, held_out boolean, part int, ids binary, word_h binary, word_c binary, id_c binary"


def _encode(path: str, pattern: str):
    """The rows with ids instead of their texts; the last row of a batch holds its counts of training words and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_pages()
        code = _subwords(path, pattern)
        for batch in batches:
            held, words, counts, by_id = batch.column(2).to_numpy(zero_copy_only=False), [], [], np.zeros(code.size, np.int64)
            for a, b, data, off in text_chunks(batch.column(4)):
                starts, ends, first = words_of(data, off, SPACE_WORDS)
                unique, at, which = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
                ids, n = code.ids_of(data.tobytes(), starts, ends, unique, at, which)
                stop = np.cumsum(n)
                upto = np.concatenate([[0], stop])[first]
                learn = ~held[a:b]
                c = np.bincount(which[np.repeat(learn, np.diff(first))], minlength=len(unique))
                words.append(word_hashes(ids, (stop - n)[at], stop[at])[c > 0])
                counts.append(c[c > 0])
                by_id += np.bincount(ids[np.repeat(learn, np.diff(upto))], minlength=code.size)
                more = [[None] * (b - a) for _ in range(3)]
                if b == batch.num_rows:
                    by_id[code.end] += (~held).sum()
                    more = [[None] * (b - a - 1) + [x.tobytes()] for x in (*_summed(np.concatenate(words), np.concatenate(counts)), by_id)]
                raw, cut = ids.tobytes(), (upto * 2).tolist()
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(a, b - a) for i in range(4)), pa.array([raw[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary()), *(pa.array(x, pa.binary()) for x in more)],
                    ["rid", "doc_id", "held_out", "part", "ids", "word_h", "word_c", "id_c"],
                )

    return run


def _summed(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash once, with the sum of its counts."""
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    new = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    return h[new], np.add.reduceat(c, new) if len(h) else c


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, h, c): counts of word hashes and of subword ids."""
    for batch in batches:
        for h, c, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            h, c, ids = (np.frombuffer(x, np.int64) for x in (h, c, ids))
            on = np.flatnonzero(ids)
            kind = np.concatenate([np.full(len(h) + 1, WORDS, np.int8), np.full(len(on), IDS, np.int8)])
            # The end of a text is the last id and counts as a word.
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([h, [END_WORD], on])), pa.array(np.concatenate([c, ids[-1:], ids[on]]))], ["kind", "h", "c"])


@dataclass
class Vocabulary:
    """By id (and for NOTHING): group, place in the group, natural log of the share of the place, input number; counts by group and place."""

    group: np.ndarray
    place: np.ndarray
    share: np.ndarray
    input: np.ndarray
    mass: np.ndarray


def make_vocabulary(counts: np.ndarray, tokens: list[bytes]) -> Vocabulary:
    """The most frequent ids, in order of their bytes (words' first ids apart), fill the groups' own places.

    Every other id joins the group of the id before it in that order, in one of the places that are shared by ids of
    about equal frequency.
    """
    by_count = np.argsort(-counts, kind="stable")
    rank = np.empty(len(tokens), np.int64)
    rank[sorted(range(len(tokens)), key=lambda i: (tokens[i][:1] == b" ", tokens[i]))] = np.arange(len(tokens))
    own, rest = by_count[: GROUPS * OWN], by_count[GROUPS * OWN :]
    own = own[np.argsort(rank[own])]
    group = np.maximum(np.searchsorted(rank[own], rank, "right") - 1, 0) // OWN
    place = np.empty(len(counts), np.int64)
    place[own] = np.arange(len(own)) % OWN
    for g in range(GROUPS):
        some = rest[group[rest] == g]
        upto = np.cumsum(np.sqrt(counts[some] + SMOOTH))
        place[some] = OWN + np.minimum(upto / upto[-1:] * (PLACES - OWN), PLACES - OWN - 1).astype(np.int64)
    weight, leaf = counts + SMOOTH, group * PLACES + place
    mass = np.bincount(leaf, weight, GROUPS * PLACES)

    def table(values: np.ndarray, nothing: int, kind: type) -> np.ndarray:
        out = np.full(NOTHING + 1, nothing, kind)
        out[: len(values)] = values
        return out

    return Vocabulary(table(group, 0, np.uint8), table(place, 0, np.intp), table(np.log(weight / mass[leaf]), 0, np.float32), table(leaf, INPUTS, np.intp), mass.reshape(GROUPS, PLACES))


def windows(ids: np.ndarray, first: np.ndarray, end: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, row, number) of the windows of the rows ids[first[r]:first[r+1]], each between two end ids.

    Window k of a row holds LENGTH inputs from place k * step on and one more id, since the target of an input is the
    next id; NOTHING stands beyond the row.
    """
    size = np.diff(first)
    many = 1 + np.maximum(0, -(-(size + 1 - LENGTH) // step))
    row = np.repeat(np.arange(len(size)), many)
    k = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    at = (k * step)[:, None] + np.arange(LENGTH + 1)
    n = size[row][:, None]
    flat = np.append(ids, np.uint16(end))
    out = flat[np.clip(first[:-1][row][:, None] + at - 1, 0, len(ids))]
    out[(at == 0) | (at == n + 1)] = end
    out[at > n + 1] = NOTHING
    return out, row, k


_LAG = np.maximum(np.arange(LENGTH)[:, None] - np.arange(LENGTH)[None, :], 0)
_SEEN = np.arange(LENGTH)[:, None] >= np.arange(LENGTH)[None, :]


def keep_pages() -> None:
    """Lets the process keep freed pages for the next arrays, up to twice HELD_BYTES.

    The C library gives memory back beyond twice the largest block that it has mapped and freed (32 MB at most); the arrays
    of a step are a few MB, so without this each step's are mapped and cleared by the kernel anew.
    """
    held = np.empty(HELD_BYTES, np.uint8)
    del held


def _flat(x: np.ndarray) -> np.ndarray:
    return x.reshape(-1, x.shape[-1])


def _sum_by(key: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
    """Writes the sum of the rows of each key to out[key]; by a sort, since adding row by row waits for each frequent key's last sum."""
    key = key.astype(np.uint16)  # numbers of 16 bits are sorted by radix
    order = np.argsort(key, kind="stable")
    key = key.take(order)
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    out[key[new]] = np.add.reduceat(rows.take(order, axis=0), new)


def _choice(h: np.ndarray, matrix: np.ndarray, chosen: np.ndarray, weight: np.ndarray | None = None):
    """log P(chosen) under softmax(h @ matrix); with `weight`, also the weighted loss's gradients by h (without its one) and matrix."""
    z = h @ matrix
    flat, at = z.ravel(), np.arange(0, z.size, z.shape[1]) + chosen
    log = flat.take(at)
    np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], z.dtype)
    log -= np.log(total)
    if weight is None:
        return log, None
    # Rows keep the factor weight / total back, so that it meets the narrow matrices only.
    flat[at] -= total
    scale = (weight / total)[:, None]
    dh = z @ matrix[:WIDTH].T
    dh *= scale
    return log, (dh, (z.T @ (h * scale)).T)


class AttentionModel:
    """One head of causal self-attention over embedded ids; s = x A x', so A and B stand for the products of its four matrices."""

    def __init__(self, mass: np.ndarray, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        make = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        of_groups = mass.sum(1) / mass.sum()
        self.p = {
            "e": make(INPUTS + 1, WIDTH), "a": make(WIDTH, WIDTH), "b": make(WIDTH, WIDTH), "c": make(WIDTH, WIDTH), "lag": np.zeros(LENGTH, np.float32), "u": make(WIDTH + 1, GROUPS), "v": make(GROUPS, WIDTH + 1, PLACES),
        }
        # The last row of the output matrices is the bias (the hidden rows end with a one), which starts at the counts.
        self.p["u"][-1] = np.log(of_groups)
        self.p["v"][:, -1] = np.log(np.maximum(mass / mass.sum(1, keepdims=True), 1e-9))

    def _attend(self, put: np.ndarray, q: int, tables: tuple, keep: bool, h: np.ndarray):
        """Writes the hidden rows of the inputs from place q on to h; with `keep`, gives what the gradient needs.

        The weights of the attention stay undivided by their sums; the narrower products are divided.
        """
        e, by_a, by_b, by_c, both, lag = tables
        x = e.take(put, axis=0)
        own = x[:, q:]
        y = by_a.take(put[:, q:], axis=0)
        s = y @ x.transpose(0, 2, 1)
        s += lag
        np.exp(s, out=s)
        over = 1 / (_flat(s) @ np.ones(LENGTH, s.dtype))[:, None]
        if not keep:
            c = _flat(s @ by_b.take(put, axis=0))
            c *= over
            c = c.reshape(own.shape)
            c += own
            c[:, 0 if q else 1 :] += by_c.take(put[:, q - 1 if q else 0 : -1], axis=0)
            h[:, :WIDTH] = _flat(c)
            return None
        seen = np.empty((len(h), 2 * WIDTH), x.dtype)  # what attention sees, and the input before
        np.multiply(_flat(s @ x), over, out=seen[:, :WIDTH])
        before = seen.reshape(*own.shape[:2], -1)[:, :, WIDTH:]
        before[:, 0] = 0
        before[:, 1:] = x[:, :-1]
        np.add(seen @ both, _flat(own), out=h[:, :WIDTH])
        return x, y, s, over, seen

    def log_places(self, put: np.ndarray, group: np.ndarray, place: np.ndarray, q: int = 0) -> np.ndarray:
        """Natural log of P(group and place of each target)."""
        return self._run(put, group, place, q, None)[0].reshape(group.shape)

    def _run(self, put: np.ndarray, group: np.ndarray, place: np.ndarray, q: int, weight: np.ndarray | None):
        p, learn, n = self.p, weight is not None, LENGTH - q
        kind = p["e"].dtype
        lag = np.where(_SEEN[q:], p["lag"][_LAG[q:]], kind.type(-1e9))
        by_b, by_c = (None, None) if learn else (p["e"] @ p["b"], p["e"] @ p["c"])
        tables = (p["e"], p["e"] @ p["a"], by_b, by_c, np.concatenate([p["b"], p["c"]]), lag)
        group, place = group.ravel(), place.ravel()
        hidden, log, kept, back = np.ones((len(group), WIDTH + 1), kind), np.empty(len(group), kind), [], []
        g = {k: np.zeros_like(v) for k, v in p.items()} if learn else None
        blocks = [(slice(a, a + BLOCK), slice(a * n, (a + BLOCK) * n)) for a in range(0, len(put), BLOCK)]
        for b, rows in blocks:
            h = hidden[rows]
            kept.append(self._attend(put[b], q, tables, learn, h))
            log[rows], d = _choice(h, p["u"], group[rows], weight[rows] if learn else None)
            if learn:
                back.append(d[0])
                g["u"] += d[1]
        order = np.argsort(group, kind="stable")
        cuts = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=GROUPS))])
        h, place, found = hidden.take(order, axis=0), place.take(order), np.empty(len(group), kind)
        w, dh = (weight.take(order), np.empty((len(h), WIDTH), kind)) if learn else (None, None)
        for j in range(GROUPS):
            some = slice(cuts[j], cuts[j + 1])
            if cuts[j] < cuts[j + 1]:
                found[some], d = _choice(h[some], p["v"][j], place[some], w[some] if learn else None)
                if learn:
                    dh[some], g["v"][j] = d
        log[order] += found
        if not learn:
            return log, None
        at = np.empty_like(order)
        at[order] = np.arange(len(order))
        whole, dx, both, by_lag = dh.take(at, axis=0), np.empty((*put.shape, WIDTH), kind), np.zeros_like(tables[4]), np.zeros_like(lag)
        for (b, rows), d, more in zip(blocks, back, kept, strict=True):
            d += whole[rows]
            self._back(d, more, tables[4], g["a"], both, by_lag, dx[b])
        g["b"], g["c"] = both[:WIDTH], both[WIDTH:]
        g["lag"] = np.bincount(_LAG.ravel(), by_lag.ravel(), LENGTH).astype(kind)
        _sum_by(put.ravel(), _flat(dx), g["e"])
        return log, g

    def _back(self, dh: np.ndarray, kept, both: np.ndarray, by_a: np.ndarray, by_both: np.ndarray, by_lag: np.ndarray, dx: np.ndarray) -> None:
        """Writes the gradient by the embedded inputs of one block to dx; adds those of the matrices to by_a, by_both and by_lag."""
        x, y, s, over, seen = kept
        by_both += seen.T @ dh
        dseen = dh @ both.T
        dc = dseen[:, :WIDTH] * over
        shift = np.einsum("ij,ij->i", dc, seen[:, :WIDTH]).reshape(len(x), LENGTH, 1)
        dc = dc.reshape(x.shape)
        np.add(dh.reshape(x.shape), s.transpose(0, 2, 1) @ dc, out=dx)
        dx[:, :-1] += dseen.reshape(len(x), LENGTH, -1)[:, 1:, WIDTH:]
        ds = dc @ x.transpose(0, 2, 1)
        ds -= shift
        ds *= s
        by_lag += ds.sum(0)
        dy = _flat(ds @ x)
        dx += ds.transpose(0, 2, 1) @ y
        by_a += _flat(x).T @ dy
        dx += (dy @ self.p["a"].T).reshape(x.shape)

    def gradient(self, put: np.ndarray, group: np.ndarray, place: np.ndarray, there: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss of the targets that are there, and its gradient."""
        weight = there.ravel().astype(self.p["e"].dtype)
        weight /= max(weight.sum(), 1)
        log, g = self._run(put, group, place, 0, weight)
        return float(-(log * weight).sum()), g


class Adam:
    """Steps on a model with running means of gradients and their squares; `mean` is the model averaged over about AVERAGED steps."""

    def __init__(self, model: AttentionModel) -> None:
        self.model, self.t = model, 0
        self.first = {k: np.zeros_like(v) for k, v in model.p.items()}
        self.second = {k: np.zeros_like(v) for k, v in model.p.items()}
        self.mean = {k: v.copy() for k, v in model.p.items()}

    def step(self, g: dict[str, np.ndarray], rate: float) -> None:
        self.t += 1
        size, scale, keep = rate / (1 - 0.9**self.t), 1 / (1 - 0.99**self.t), max(1 / AVERAGED, 1 / self.t)
        for k, d in g.items():
            one, two, p = self.first[k], self.second[k], self.model.p[k]
            one += 0.1 * (d - one)
            two += 0.01 * (d * d - two)
            p -= np.float32(size) * one / (np.sqrt(two * np.float32(scale)) + np.float32(1e-8))
            self.mean[k] += np.float32(keep) * (p - self.mean[k])


def id_chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, ids, row offsets) of about IDS_AT_ONCE ids each."""
    for a, b, data, off in text_chunks(column, 2 * IDS_AT_ONCE, None):
        yield a, b, np.frombuffer(data.tobytes(), np.uint16), off // 2


def _learn(held, rate: float, seen: int):
    """(n, p): windows of the task's rows and the parameters after steps on each of them once, by chunks in random order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_pages()
        start, voc, end = held.value
        model = AttentionModel(voc.mass)
        model.p = {k: v.copy() for k, v in start.items()}
        rng, adam, n = np.random.default_rng(SEED), Adam(model), 0
        for batch in batches:
            for _, _, ids, first in id_chunks(batch.column(0)):
                found, _, _ = windows(ids, first, end, LENGTH)
                order, done = rng.permutation(len(found)), 0
                while done < len(found):
                    size = int(np.clip(LEAST_BATCH * ((seen + n) / FEW) ** 2, LEAST_BATCH, MOST_BATCH))
                    on = found[order[done : done + size]]
                    aim = on[:, 1:]
                    _, g = model.gradient(voc.input.take(on[:, :-1]), voc.group.take(aim), voc.place.take(aim), aim != NOTHING)
                    adam.step(g, rate * min(1, len(on) / LEAST_BATCH))
                    done, n = done + len(on), n + len(on)
        if n:
            flat = np.concatenate([adam.mean[k].ravel() for k in sorted(adam.mean)]) * np.float64(n)
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([1]), pa.array([flat.astype(np.float32).tobytes()], pa.binary())], ["n", "tasks", "p"])

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the task's rows (n, tasks, p)."""
    n, tasks, total = 0, 0, None
    for batch in batches:
        for more, k, p in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            p = np.frombuffer(p, np.float32).astype(np.float64)
            n, tasks, total = n + more, tasks + k, p if total is None else total + p
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([tasks]), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["n", "tasks", "p"])


def train_on_all(rows: DataFrame, model: AttentionModel, vocabulary: Vocabulary, end: int) -> int:
    """Trains on every window of the rows (part, ids), each once, and gives their number; data and models of tasks stay on executors."""
    windows_seen, each, context = 0, 0, rows.sparkSession.sparkContext
    for low, high, rate in zip((0, *ROUNDS[:-1]), ROUNDS, RATES, strict=True):
        held = context.broadcast((model.p, vocabulary, end))
        made = rows.filter((F.col("part") >= low) & (F.col("part") < high)).select("ids").mapInArrow(_learn(held, rate, each), "n long, tasks long, p binary")
        found = made.repartition(SUMS).mapInArrow(_add_up, "n long, tasks long, p binary").collect()
        n = sum(x["n"] for x in found)
        if n:
            mean, at = sum(np.frombuffer(x["p"], np.float32).astype(np.float64) for x in found) / n, 0
            new = {}
            for k in sorted(model.p):
                new[k] = mean[at : at + model.p[k].size].reshape(model.p[k].shape).astype(np.float32)
                at += model.p[k].size
            model.p = new
            each += n // sum(x["tasks"] for x in found)
        windows_seen += n
        held.unpersist()
    return windows_seen


@dataclass
class Scorer:
    """Everything of fixed size that scoring needs."""

    model: AttentionModel
    vocabulary: Vocabulary
    head: np.ndarray
    head_counts: np.ndarray
    ends: int
    total: int

    def log10_ids(self, ids: np.ndarray, first: np.ndarray, end: int) -> np.ndarray:
        """log10 P of the targets of all rows: each row's ids, then its end."""
        voc, out, step = self.vocabulary, np.empty(len(ids) + len(first) - 1), LENGTH - CONTEXT
        found, row, k = windows(ids, first, end, step)
        for q, on in ((0, np.flatnonzero(k == 0)), (CONTEXT, np.flatnonzero(k > 0))):
            for a in range(0, len(on), MOST_BATCH):
                some = on[a : a + MOST_BATCH]
                put, aim = found[some, :-1], found[some, 1 + q :]
                log = self.model.log_places(voc.input.take(put), voc.group.take(aim), voc.place.take(aim), q)
                log += voc.share.take(aim)
                at = (first[row[some]] + row[some] + k[some] * step)[:, None] + np.arange(q, LENGTH)
                there = aim != NOTHING
                out[at[there]] = log[there] / np.log(10)
        return out

    def log10(self, ids: np.ndarray, first: np.ndarray, begin: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The attention model's log10 P of each word and of each row's end; words begin at ids[begin[:-1]]."""
        got = self.log10_ids(ids, first, end)
        upto = np.concatenate([[0.0], np.cumsum(got)])
        row = np.searchsorted(first, begin[:-1], "right") - 1
        return upto[begin[1:] + row] - upto[begin[:-1] + row], got[first[1:] + np.arange(len(first) - 1)]

    def mix(self, attention: np.ndarray, counts: np.ndarray | int) -> np.ndarray:
        """log10 of the mixture of the attention model's probability and the share of all training tokens."""
        return np.log10((1 - SHARE) * 10.0 ** np.maximum(attention, -290) + SHARE * counts / max(self.total, 1))


_ROWS = "rid long, doc_id {id}, held_out boolean, n_tokens long, known long, logs double, score double, tail array<struct<h:long,a:array<double>>>"


def _score(held, path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_pages()
        code, it = _subwords(path, pattern), held.value
        ends = np.log10(it.ends + SMOOTH)
        for batch in batches:
            for a, b, ids, first in id_chunks(batch.column(3)):
                rows, begin = b - a, np.append(np.flatnonzero(code.first[ids]), len(ids))
                h, row = word_hashes(ids, begin[:-1], begin[1:]), np.searchsorted(first, begin[:-1], "right") - 1
                at = np.minimum(np.searchsorted(it.head, h.view(np.int64)), max(len(it.head) - 1, 0))
                on = it.head[at] == h.view(np.int64) if len(it.head) else np.zeros(len(h), bool)
                attention, last = it.log10(ids, first, begin, code.end)
                score = np.bincount(row[on], it.mix(attention[on], it.head_counts[at[on]]), rows) + it.mix(last, it.ends)
                logs = np.bincount(row[on], np.log10(it.head_counts[at[on]] + SMOOTH), rows) + ends
                known = np.bincount(row[on], minlength=rows) + (it.ends > 0)
                rest, rest_row, attention = h[~on], row[~on], attention[~on]
                order = np.lexsort((rest, rest_row))
                rest, rest_row, attention = rest[order], rest_row[order], attention[order]
                new = np.flatnonzero(np.append(True, (rest[1:] != rest[:-1]) | (rest_row[1:] != rest_row[:-1]))) if len(rest) else np.zeros(0, np.int64)
                each = pa.ListArray.from_arrays(pa.array(np.append(new, len(rest)).astype(np.int32)), pa.array(attention))
                tail = pa.StructArray.from_arrays([pa.array(rest[new].view(np.int64)), each], ["h", "a"])
                cuts = np.searchsorted(rest_row[new], np.arange(rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(a, rows) for i in range(3)), pa.array(np.bincount(row, minlength=rows) + 1), pa.array(known.astype(np.int64)), pa.array(logs), pa.array(score), pa.ListArray.from_arrays(pa.array(cuts), tail)],
                    ["rid", "doc_id", "held_out", "n_tokens", "known", "logs", "score", "tail"],
                )

    return run


def frequent(words: DataFrame, most: int) -> DataFrame:
    """The words (h, c) above the least count that at most `most` words exceed; found from a histogram, without a sort."""
    step = F.floor(F.log2("c") * 8).cast("int")
    seen, least = 0, None
    for r in words.groupBy(step.alias("step")).count().orderBy(F.col("step").desc()).collect():  # at most 8 rows for each doubling
        seen += r["count"]
        if seen > most:
            break
        least = r["step"]
    return words.filter(step >= least) if least is not None else words.filter("false")


def lm_scores(docs: DataFrame, tokenizer_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Words are runs of anything but ASCII white space, A-Z in lower case; the end of a text is a token too.  base_score
    is the smoothed unigram log10 probability of the words, score that of the attention model over the words' subword ids
    mixed with the words' shares of all training tokens.
    Null and empty texts are only their end; a null id is held out; without training rows every count is 0;
    equal texts score alike up to rounding; repeated rows count as often as they are there; the tasks' share of the rows
    may move score a little; other columns are not read.  `tokenizer_path` is a byte-level BPE that executors can read.
    """
    spark = docs.sparkSession
    fold, text = remainder(F.col(f"`{id_col}`"), FOLDS) == HELD_OUT, F.col(f"`{text_col}`")
    part = F.pmod(F.xxhash64(F.col(f"`{id_col}`").cast("string"), text), F.lit(PARTS)).cast("int")
    named = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").alias("doc_id"), fold.alias("held_out"), part.alias("part"), text.alias("text"))
    id_type = named.schema["doc_id"].dataType.simpleString()
    rows = materialise(named.mapInArrow(_encode(tokenizer_path, pattern), _ENCODED.format(id=id_type)), "lm-ids")
    tally = rows.filter("word_h is not null").select("word_h", "word_c", "id_c").mapInArrow(_tally, "kind byte, h long, c long")
    counts = materialise(tally.groupBy("kind", "h").agg(F.sum("c").alias("c")).filter("c > 0"), "lm-counts")
    words = counts.filter(F.col("kind") == WORDS).select("h", "c")
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    ends = words.filter(F.col("h") == END_WORD).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    head = frequent(words.filter(F.col("h") != END_WORD), HEAD_WORDS).toArrow()
    order = np.argsort(head.column("h").to_numpy())

    code = _subwords(tokenizer_path, pattern)
    by_id = np.zeros(code.size)
    for r in counts.filter(F.col("kind") == IDS).toLocalIterator():  # at most one row for each id of the vocabulary
        by_id[r["h"]] = r["c"]
    vocabulary = make_vocabulary(by_id, code.tokens)
    model = AttentionModel(vocabulary.mass)
    train_on_all(rows.filter("not held_out").select("part", "ids"), model, vocabulary, code.end)
    scorer = Scorer(model, vocabulary, head.column("h").to_numpy()[order], head.column("c").to_numpy()[order], int(ends), int(total))
    held = spark.sparkContext.broadcast(scorer)

    scored = rows.select("rid", "doc_id", "held_out", "ids").mapInArrow(_score(held, tokenizer_path, pattern), _ROWS.format(id=id_type))
    scored = materialise(scored, "lm-rows")
    discard(rows)
    tail = scored.select("rid", F.explode("tail").alias("t")).select("rid", "t.h", "t.a", F.size("t.a").alias("n")).join(words, "h", "left")
    unigram = F.coalesce("c", F.lit(0)) * (SHARE / max(total, 1))
    mixed = F.aggregate("a", F.lit(0.0), lambda s, a: s + F.when(F.col("c") > 0, F.log10((1 - SHARE) * F.pow(F.lit(10.0), F.greatest(a, F.lit(-290.0))) + unigram)).otherwise(a + float(np.log10(1 - SHARE))))
    tail = tail.groupBy("rid").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more"), F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)).alias("tail_logs"), F.sum(mixed).alias("tail_score"))
    share = float(np.log10(total + SMOOTH * (distinct + 1)))
    return scored.drop("tail").join(tail, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("tail_logs", F.lit(0.0)) - F.col("n_tokens") * share).alias("base_score"),
        (F.col("score") + F.coalesce("tail_score", F.lit(0.0))).alias("score"),
    )

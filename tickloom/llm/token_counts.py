"""Token counts by a compiled finite-state tokenizer.

The tokenizer's text splitter is compiled to a deterministic transducer over character classes, whose
transitions tell where pieces begin.  A text is cut into chunks of fixed length; each chunk's map from entry state
to exit state is found for all states at once, the maps are composed by a parallel prefix scan, and a second sweep
from the known entry states yields the pieces.

Only the splitter is a transducer.  Merging inside a piece is ranked, and a transducer for it would have a state for each
prefix that matters to later merges, too many to compile beforehand: each distinct piece is merged once by the merge list, its
count is kept, and the transition that ends the piece emits that number.  Character classes and lower case are those of the
tokenizer library, also where its Unicode version is younger than Python's.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64

CHUNK, CHARS = 64, 1 << 19
#: Piece counts kept by one task before they are compiled anew.
KEPT = 2_000_000
LIMIT = 2048

#: Character classes of the splitter: white space, letter, digit, other, apostrophe, and the letters of contractions.
SPACE, LETTER, DIGIT, OTHER, APOSTROPHE, STMD, R, V, L, E, NOTHING = range(11)
#: States: between pieces; in letters; in other characters; after an apostrophe that begins a piece; after 'r, 'v, 'l.
BETWEEN, IN_LETTERS, IN_OTHER, AFTER, AFTER_R, AFTER_V, AFTER_L = range(7)
STATES = 7
#: What a transition tells: a piece begins at this character; one began at the character before it.
HERE, BEFORE = 1, 2


def compile_splitter() -> tuple[np.ndarray, np.ndarray]:
    """Transitions and outputs (class by state) for: 's 't 're 've 'm 'll 'd, letter runs, single digits, runs of others."""
    go, out = np.zeros((11, STATES), np.uint8), np.zeros((11, STATES), np.uint8)
    letters = (LETTER, STMD, R, V, L, E)
    for s in range(STATES):
        late = BEFORE if s >= AFTER_R else 0  # the letter after the apostrophe turns out to begin a piece
        go[SPACE, s], out[SPACE, s] = BETWEEN, late
        go[DIGIT, s], out[DIGIT, s] = BETWEEN, late | HERE
        for c in letters:
            go[c, s], out[c, s] = IN_LETTERS, late or (0 if s == IN_LETTERS else HERE)
        runs = s in (IN_OTHER, AFTER)
        go[OTHER, s], out[OTHER, s] = IN_OTHER, late | (0 if runs else HERE)
        go[APOSTROPHE, s], out[APOSTROPHE, s] = (IN_OTHER, 0) if runs else (AFTER, late | HERE)
        go[NOTHING, s] = s
    for c, to in ((STMD, BETWEEN), (R, AFTER_R), (V, AFTER_V), (L, AFTER_L)):
        go[c, AFTER], out[c, AFTER] = to, 0
    for c, s in ((E, AFTER_R), (E, AFTER_V), (L, AFTER_L)):
        go[c, s], out[c, s] = BETWEEN, 0
    return go, out


#: Code points that the tables are checked for against the library: planes 0 to 3 without surrogates.
CHECKED = [p for p in range(0x80, 0x40000) if not 0xD800 <= p < 0xE000]


@cache
def lower_overrides() -> dict[int, str]:
    """Characters that the tokenizer library puts into lower case otherwise than Python does (it knows another Unicode version)."""
    from tokenizers.normalizers import Lowercase

    whole = "\n".join(map(chr, CHECKED))
    mine, theirs = whole.lower().split("\n"), Lowercase().normalize_str(whole).split("\n")
    return {p: b for p, a, b in zip(CHECKED, mine, theirs, strict=True) if a != b and chr(p) != "Σ"}


def _younger_letters_and_digits() -> dict[int, int]:
    """Classes of the characters that Python's tables do not know, as the tokenizer library's expressions see them."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    unknown = [p for p in CHECKED if unicodedata.category(chr(p)) == "Cn"]
    out = {}
    for kind, expression in ((LETTER, r"\p{L}"), (DIGIT, r"\p{N}")):
        found = Split(Regex(expression), "removed", invert=True).pre_tokenize_str(" ".join(map(chr, unknown)))
        out |= {ord(piece): kind for piece, _ in found}
    return out


@cache
def class_table() -> np.ndarray:
    """Class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    kinds = {"L": LETTER, "N": DIGIT}
    for point in range(0x110000):
        if kind := kinds.get(unicodedata.category(chr(point))[0]):
            table[point] = kind
    for point, kind in _younger_letters_and_digits().items():
        table[point] = kind
    table[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    for chars, kind in (("'", APOSTROPHE), ("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E)):
        table[[ord(c) for c in chars]] = kind
    return table


def piece_starts(classes: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Flags of the characters at which pieces begin."""
    go, out = tables
    n = len(classes)
    rows = -(-n // CHUNK)
    grid = np.full(rows * CHUNK, NOTHING, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T)
    maps = np.broadcast_to(np.arange(STATES, dtype=np.uint8), (rows, STATES)).copy()
    flat, width = go.ravel(), np.intp(STATES)
    for c in grid:
        maps = flat[c.astype(np.intp)[:, None] * width + maps]
    step = 1
    while step < rows:  # inclusive scan of map composition: first the earlier chunks, then this one
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), 1)
        step *= 2
    state = np.empty(rows, np.uint8)
    state[0], state[1:] = BETWEEN, maps[:-1, BETWEEN]
    told = np.empty((CHUNK, rows), np.uint8)
    for j, c in enumerate(grid):
        at = c.astype(np.intp) * width + state
        told[j], state = out.ravel()[at], flat[at]
    told = told.T.ravel()
    starts = (told & HERE) > 0
    starts[:-1] |= (told[1:] & BEFORE) > 0
    # An end of text inside 'r, 'v or 'l: callers end every text with a space, so there is none.
    return starts[:n]


class WordBpe:
    """Token counts of pieces under a BPE with word ends, and the strings that are tokens by themselves."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.end = spec["model"]["end_of_word_suffix"]
        self.ranks = {(a, b): i for i, (a, b) in enumerate(spec["model"]["merges"])}
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]))
        self.letters = byte_letters()
        self.counts: dict[int, int] = {}

    def tokens(self, piece: str) -> int:
        """Number of tokens of one piece: the merge of least rank, leftmost first, until none applies."""
        parts = [self.letters[b] for b in piece.encode("utf-8")]
        parts[-1] += self.end
        if len(parts) > 48:
            return self._long(parts)
        ranks = self.ranks
        while len(parts) > 1:
            best, at = min((ranks.get(pair, 1 << 30), i) for i, pair in enumerate(zip(parts, parts[1:])))  # noqa: B905, RUF007
            if best == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return len(parts)

    def _long(self, parts: list[str]) -> int:
        """The same with a heap of merges, for pieces of any length."""
        n, ranks = len(parts), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = a + b, "", after[j]
            left -= 1
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get((parts[i], parts[after[i]]))) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[after[i]]))
            if (p := before[i]) >= 0 and (r := ranks.get((parts[p], parts[i]))) is not None:
                heapq.heappush(heap, (r, p, parts[p], parts[i]))
        return left


def byte_letters() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies: its own character where that prints, else the next free one from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


_HASH = np.uint64(0x9E3779B97F4A7C15)


def _piece_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of points[start:end]."""
    n = len(points)
    up = np.full(n + 1, _HASH)
    up[0] = 1
    np.cumprod(up, out=up)
    down = np.full(n + 1, np.uint64(pow(int(_HASH), -1, 1 << 64)))
    down[0] = 1
    np.cumprod(down, out=down)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def count_texts(texts: list[str | None], model: WordBpe) -> np.ndarray:
    """Tokens of each text as the tokenizer gives them, without tokens that it would add itself."""
    out = np.zeros(len(texts), np.int64)
    tables, a = compile_splitter(), 0
    while a < len(texts):
        parts, size, b = [], 0, a
        while b < len(texts) and (b == a or size + len(texts[b] or "") <= CHARS):
            text = texts[b] or ""
            if "<|" in text:
                text, found = model.special.subn(" ", text)
                out[b] += found
            if not text.isascii() and not unicodedata.is_normalized("NFC", text):
                text = " ".join(unicodedata.normalize("NFC", t) for t in text.split(" "))
            if not text.isascii():
                text = text.translate(lower_overrides()) if _overridden().search(text) else text
            parts.append(text.replace("Σ", "σ").lower() + " ")  # lower case here knows no word ends
            size += len(parts[-1])
            b += 1
        whole = "".join(parts)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
        classes = class_table()[points]
        starts = piece_starts(classes, tables)
        cuts = np.append(np.flatnonzero(starts | (classes == SPACE)), len(points))
        is_piece = starts[cuts[:-1]]
        begin, end = cuts[:-1][is_piece], cuts[1:][is_piece]
        hashes, first, which = np.unique(_piece_hashes(points, begin, end), return_index=True, return_inverse=True)
        known = model.counts
        if len(known) > KEPT:
            known.clear()
        counts = np.empty(len(hashes), np.int64)
        for k, (h, i) in enumerate(zip(hashes.tolist(), first.tolist(), strict=True)):
            n = known.get(h)
            if n is None:
                n = known[h] = model.tokens(whole[begin[i] : end[i]])
            counts[k] = n
        rows = np.searchsorted(np.cumsum([len(p) for p in parts]), begin, "right")
        out[a:b] += np.bincount(rows, counts[which], b - a).astype(np.int64)
        a = b
    return out


@cache
def _overridden() -> re.Pattern:
    return re.compile("[" + "".join(map(chr, lower_overrides())) + "]" if lower_overrides() else "(?!)")


@cache
def _model(path: str) -> WordBpe:
    return WordBpe(path)


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    `tokenizer_path` is a word-end BPE file that every executor can read.  Null and empty texts have no tokens; equal
    texts have equal counts; very long texts are counted whole; other columns are not read.
    """

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array(count_texts(texts.to_pylist(), _model(tokenizer_path)), pa.int64())

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    out = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), count(text).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)

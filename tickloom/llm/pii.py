"""Personal data by weak supervision.

Four plain patterns (email, ip, card, phone) give base spans, which always stay.  Wider patterns nominate more
spans.  Labelers (formats, checksums, gazetteers, words before the span) vote on every candidate; expectation-
maximisation estimates each labeler's reliability from the counts of vote patterns over all candidates; the posteriors
train a logistic span classifier on a bounded sample, which decides about the nominated spans of every document.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "number", "contact", "secret", "name")
#: Candidates at most on which the span classifier is fitted (a parameter of personal_data), its hashed features, and the
#: probability that adds a span.
SAMPLE, FEATURES, CUT = 20_000, 1024, 0.8
EM_STEPS, FIT_STEPS, RIDGE = 50, 300, 1e-3
CONTEXT = 40

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"(?<![\w.])[0-9][0-9 ().-]{5,22}[0-9](?![\w])")
_CONTACT = re.compile(r"[A-Za-z0-9._-]{1,64}\s?[\[(]at[\])]\s?[A-Za-z0-9-]{1,63}(?:\s?(?:[\[(]dot[\])]|\.)\s?[A-Za-z]{2,63}){1,4}", re.IGNORECASE)
_SECRET = re.compile(r"(?:token|password|passwd|secret|api[_ -]?key)\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9_+/.-]{8,}+)", re.IGNORECASE)
_NAME = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Herr|Frau|Señora|Señor|Mme)\b\.? ([A-Z][^\W\d_]{1,30}(?: [A-Z][^\W\d_]{1,30})?)")
_HAS_DIGIT = re.compile(r"[0-9]")

#: Gazetteers (fixed values): domain endings, card issuers' first digits, given names, words that announce or rule out.
ENDINGS = frozenset("com net org edu gov info io de fr es uk eu us".split())
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65")
NAMES = frozenset("anna maria john mary peter paul david michael thomas laura sarah james robert juan carlos ana jean pierre marie hans klaus julia".split())
ANNOUNCE = re.compile(r"(?:phone|tel|telefon|téléphone|teléfono|call|mobile|fax|card|karte|carte|tarjeta|account|konto|iban|passport|ssn|mail|contact|token|password|secret|key|name)\W{0,5}(?:\w+\W{1,3}){0,2}$", re.IGNORECASE)
RULE_OUT = re.compile(r"(?:version|isbn|page|seite|year|jahr|order|price|preis|prix|chapter|section|figure|[$€£%#])\W{0,3}$", re.IGNORECASE)
_DATE = re.compile(r"(?:19|20)\d\d[-./ ](?:0?\d|1[0-2])[-./ ](?:[0-2]?\d|3[01])$|(?:[0-2]?\d|3[01])[-./ ](?:0?\d|1[0-2])[-./ ](?:19|20)\d\d$")
LABELERS = 7


def luhn(digits: str) -> bool:
    """The check of card numbers: from the right every second digit doubled, sum of digits divisible by ten."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) << (i & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ outwards (so linear in the text)."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if _HAS_DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() <= 40 and 12 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(out)


def nominated(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the wider patterns that overlap no base span or earlier nomination."""
    found: list[tuple[int, int, int]] = []
    if _HAS_DIGIT.search(text):
        found += [(m.start(), 4, m.end()) for m in _DIGITS.finditer(text) if sum(c.isdigit() for c in m[0]) >= 7]
    low = text.lower()
    if "(at)" in low or "[at]" in low:
        found += [(m.start(), 5, m.end()) for m in _CONTACT.finditer(text)]
    if any(w in low for w in ("token", "passw", "secret", "api")):
        found += [(m.start(1), 6, m.end(1)) for m in _SECRET.finditer(text)]
    if any(w in text for w in ("Mr", "Ms", "Dr", "Herr", "Frau", "Señor", "Mme")):
        found += [(m.start(1), 7, m.end(1)) for m in _NAME.finditer(text)]
    out, taken, k, last = [], sorted((s, e) for s, _, e in base), 0, 0
    reach = 0
    for s, kind, e in sorted(found):
        while k < len(taken) and taken[k][0] < e:
            reach = max(reach, taken[k][1])
            k += 1
        if s >= last and reach <= s:
            out.append((s, kind, e))
            last = e
    return out


def votes(text: str, start: int, kind: int, end: int) -> list[int]:
    """One vote a labeler: 1 personal, 2 not, 0 no opinion."""
    span, before = text[start:end], text[max(0, start - CONTEXT) : start]
    digits = "".join(c for c in span if c in "0123456789")
    well = (
        (kind == 0) or (kind == 1) or (kind in (2, 4) and 12 <= len(digits) <= 19 and luhn(digits)) or (kind == 3) or (kind == 6 and len(span) >= 20 and len(digits) >= 4)
    )
    numeric = kind in (2, 3, 4)
    shape = numeric and bool(re.search(r"\d{3}[ .)-]{1,2}\d{3}[ .-]?\d{4}", span))
    listed = (
        (kind in (0, 5) and re.split(r"[\s.\])]+", span.lower())[-1] in ENDINGS) or (kind in (2, 4) and len(digits) >= 12 and digits.startswith(ISSUERS)) or (kind == 3 and digits[:1] in ("1", "3", "4", "5"))
        or (kind == 7 and span.lower().split()[0] in NAMES)
    )
    return [
        1 if kind < 4 else 0,
        1 if well else 2 if kind == 4 and len(digits) >= 12 else 0,
        1 if shape else 0,
        1 if listed else 2 if kind in (4, 7) else 0,
        1 if ANNOUNCE.search(before) else 0,
        2 if RULE_OUT.search(before) else 0,
        2 if kind == 4 and (_DATE.match(span) or "." in span and len(digits) < 9 or len(set(digits)) <= 2) else 0,
    ]


def hashed(text: str, start: int, kind: int, end: int, vote: list[int]) -> list[int]:
    """Feature numbers of a span: kind, votes, length, character shape and the words before it."""
    span = text[start:end]
    shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]", "9", span))[:24]
    words = [f"k{kind}", f"k{kind}l{min(end - start, 40) // 4}", f"s{shape}", *(f"v{i}{v}" for i, v in enumerate(vote)), *(f"k{kind}v{i}{v}" for i, v in enumerate(vote))]
    words += [f"b{w}" for w in re.findall(r"\w+", text[max(0, start - CONTEXT) : start].lower())[-3:]]
    return sorted({zlib.crc32(w.encode()) % FEATURES for w in words})


_SCHEMA = "doc_id {id}, spans array<struct<kind:int,start:int,end:int,pattern:int,x:array<int>>>"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("pattern", pa.int32()), ("x", pa.list_(pa.int32()))]))
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            text = text or ""
            base = base_spans(text)
            row = []
            for s, k, e in base + nominated(text, base):
                vote = votes(text, s, k, e)
                row.append({"kind": k, "start": s, "end": e, "pattern": sum(v * 3**i for i, v in enumerate(vote)), "x": hashed(text, s, k, e, vote)})
            rows.append(row)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])


def reliabilities(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns: (P(vote | class) by labeler, P(personal) by pattern)."""
    vote = np.stack([patterns // 3**i % 3 for i in range(LABELERS)], 1).astype(int).reshape(-1, LABELERS)
    post = np.clip(0.5 + 0.25 * ((vote == 1).sum(1) - (vote == 2).sum(1)), 0.05, 0.95)
    table = np.zeros((LABELERS, 2, 3))
    # Labelers are taken to be better than chance, with the weight of a fortieth of the candidates.
    trust = (10 + counts.sum() / 40) * np.array([[0.6, 0.1, 0.3], [0.6, 0.3, 0.1]])
    for _ in range(EM_STEPS):
        share = np.clip((post * counts).sum() / max(counts.sum(), 1), 0.01, 0.99)
        for i in range(LABELERS):
            for v in range(3):
                on = vote[:, i] == v
                table[i, 1, v] = (post * counts)[on].sum() + trust[1, v]
                table[i, 0, v] = ((1 - post) * counts)[on].sum() + trust[0, v]
        table /= table.sum(2, keepdims=True)
        z = np.full(len(vote), np.log(share / (1 - share)))
        for i in range(LABELERS):
            z += np.log(table[i, 1, vote[:, i]] / table[i, 0, vote[:, i]])
        post = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return table, post


@dataclass
class SpanClassifier:
    weights: np.ndarray
    bias: float

    def keeps(self, x: list[int]) -> bool:
        return 1 / (1 + np.exp(-np.clip(self.weights[x].sum() + self.bias, -30, 30))) >= CUT


def fit_spans(xs: list[list[int]], soft: np.ndarray) -> SpanClassifier:
    """Logistic regression on hashed features with soft labels, by gradient descent; nothing is added without candidates."""
    if not xs:
        return SpanClassifier(np.zeros(FEATURES), -30.0)
    row, at = np.repeat(np.arange(len(xs)), [len(x) for x in xs]), np.concatenate([np.array(x, np.int64) for x in xs])
    w, b, v, vb = np.zeros(FEATURES), 0.0, np.zeros(FEATURES), 0.0
    for _ in range(FIT_STEPS):
        e = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[at], len(xs)) + b, -30, 30))) - soft
        v = 0.9 * v - 0.1 * (np.bincount(at, e[row], FEATURES) / len(xs) + RIDGE * w)
        vb = 0.9 * vb - 0.1 * e.mean()
        w, b = w + v, b + vb
    return SpanClassifier(w, float(b))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, spans array<struct<kind, start, end, base>> by start, then kind.

    Reliabilities come from the candidates of all documents; the span classifier is fitted on at most `sample` of them,
    those with the least hashes.  Offsets count code points, ends are exclusive.  Null and empty texts have no spans; equal
    texts have equal spans, repeated rows each have theirs; texts are read whole; an empty table gives an empty one; other
    columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = materialise(rows.mapInArrow(_extract, _SCHEMA.format(id=rows.schema["doc_id"].dataType.simpleString())), "pii")
    spans = rows.select(F.explode("spans").alias("s")).select("s.*")
    seen = spans.groupBy("pattern").count().collect()  # at most 3**LABELERS rows
    patterns, counts = np.array([r["pattern"] for r in seen], np.int64), np.array([r["count"] for r in seen], float)
    _, post = reliabilities(patterns, counts)
    soft = dict(zip(patterns.tolist(), post.tolist(), strict=True))
    some = spans.orderBy(F.xxhash64("pattern", "start", "end", "x"), "pattern", "x").limit(sample).select("pattern", "x").collect()
    model = spark.sparkContext.broadcast(fit_spans([r["x"] for r in some], np.array([soft[r["pattern"]] for r in some])))

    @F.arrow_udf("array<boolean>")
    def kept(found: pa.Array) -> pa.Array:
        return pa.array([[s["kind"] < len(BASE_KINDS) or bool(model.value.keeps(s["x"])) for s in row] for row in found.to_pylist()], pa.list_(pa.bool_()))

    base = len(BASE_KINDS)
    picked = F.filter(F.arrays_zip(F.col("spans").alias("s"), kept("spans").alias("on")), lambda z: z["on"])
    ordered = F.array_sort(F.transform(picked, lambda z: F.struct(z["s"]["start"].alias("start"), z["s"]["kind"].alias("kind"), z["s"]["end"].alias("end"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    out = F.transform(ordered, lambda s: F.struct(names[s["kind"]].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), (s["kind"] < base).alias("base")))
    return rows.select("doc_id", out.alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts by base kind, base_sha256 and the spans as text."""
    text = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    base = F.filter("spans", lambda s: s["base"])
    of = lambda kind: F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


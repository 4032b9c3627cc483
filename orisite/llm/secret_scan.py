"""Secrets in texts: three patterns, and what two character Markov models tell apart.

Patterns (leftmost matches that do not overlap, per kind, then those that are too short go):
*assign*, a keyword with a value of 6 characters or more; *access*, ``AKIA`` and capitals or digits, 20
or more; *hex*, 24 or more hexadecimal digits.

Method.  Two first-order Markov models over the characters ``A-Za-z0-9+/_=-`` and a border: of *random
strings* and of *ordinary identifiers*.  The samples label themselves: random are the values of
pattern matches that hold a letter and a digit; ordinary is every other token of ``TRAIN_LENGTH``
characters or more.  All texts are counted (a task returns its two tables, of 68 x 68 numbers).  Case
tells nothing, so each sample counts as written, in lower case and in capitals.  Random strings may
hold anything: their model is mixed with a uniform one, by ``UNIFORM``.  A token of ``MIN_LENGTH``
characters or more with a letter, outside the pattern matches, is a secret (*markov*) if the
log-likelihood ratio of the models exceeds the log odds of ordinary to random tokens in the samples by
``MARGIN``.  Plain numbers are left alone.

Defined results: a null text is empty; positions are code points, ends exclusive; spans are ordered by
start and then kind, as listed; rows are scanned each, repeated or not.  Without samples the models
are uniform and nothing is added to the patterns.  Texts are scanned whole; a long one in pieces cut
at blanks, which no token holds (the patterns see it uncut).  An empty table gives an empty result.
Columns may have any name; only the text is read, the kept ones pass through in a struct.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from orisite.llm.common import bounded_batches, byte_texts, pieces

# The kinds, in the order of equal starts, and their patterns.
KINDS = ("assign", "access", "hex", "markov")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24
MIN_LENGTH, TRAIN_LENGTH = 16, 8
#: Share of the uniform model in that of random strings; weight, in pairs, of a uniform prior on what
#: follows each character in ordinary tokens (few secrets among them must not make theirs common).
UNIFORM, PRIOR = 0.1, 200.0
#: Log odds by which a token must look random, on top of the samples' odds.
MARGIN = 7.0

CHARACTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIZE = len(CHARACTERS) + 1  # class 0 is the border
CLASS = np.zeros(256, np.uint8)
CLASS[np.frombuffer(CHARACTERS, np.uint8)] = np.arange(1, SIZE)
BYTES = np.arange(256, dtype=np.uint8).tobytes()
#: Classes of the bytes as written, in lower case and in capitals.
FORMS = [CLASS[np.frombuffer(b, np.uint8)] for b in (BYTES, BYTES.lower(), BYTES.upper())]
IS_LETTER = (CLASS > 0) & (CLASS <= 52)
IS_HEX = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdef", np.uint8))

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


def runs(member: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``length`` or more."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], member, [False]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    keep = end - start >= length
    return start[keep], end[keep]


def pattern_spans(text: bytes) -> list[Span]:
    """The *assign* and *access* matches of a text, in bytes."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(*m.span()[:1], 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
    if b"AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LENGTH]
    return out


def buffers(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, and for each part where it starts, the number of its text, where it starts in the text):
    texts, or pieces of long ones, a border apart."""
    done: dict[int, int] = {}
    for nos, parts in pieces(texts):
        buf = np.frombuffer(b" " + b" ".join(parts) + b" ", np.uint8)
        starts = np.cumsum([1] + [len(p) + 1 for p in parts[:-1]])
        offset = []
        for no, p in zip(nos, parts):
            offset.append(done.get(no, 0))
            done[no] = offset[-1] + len(p)
        yield buf, starts, np.asarray(nos), np.asarray(offset)


def base_spans(texts: list[bytes]) -> list[list[Span]]:
    """The matches of all patterns in each text, in bytes and in order."""
    out = [pattern_spans(t) for t in texts]
    for buf, starts, nos, offset in buffers(texts):
        for s, e in zip(*runs(IS_HEX[buf], HEX_LENGTH)):
            k = int(np.searchsorted(starts, s, side="right")) - 1
            at = int(offset[k] + s - starts[k])
            out[nos[k]].append((at, 2, at + int(e - s)))
    return [sorted(s) for s in out]


def value_of(text: bytes, span: Span) -> bytes:
    """What a match holds besides its keyword."""
    found = text[span[0]: span[2]]
    return ASSIGN.match(found)[2] if span[1] == 0 else found


def pair_counts(buf: np.ndarray, length: int) -> tuple[np.ndarray, int]:
    """(how often each class follows each within the tokens of ``length`` or more, borders included, in
    all forms; number of tokens that may be told random)."""
    start, end = runs(CLASS[buf] > 0, length)
    inside = np.zeros(len(buf) + 1, np.int8)
    inside[start] = 1
    inside[end] = -1
    inside = np.cumsum(inside[:-1]).astype(bool)
    total = np.zeros(SIZE * SIZE, np.int64)
    for form in FORMS:
        c = np.where(inside, form[buf], 0).astype(np.int32)
        total += np.bincount(c[:-1] * SIZE + c[1:], minlength=SIZE * SIZE)
    total[0] = 0
    return total, int((end - start >= MIN_LENGTH).sum())


def sample_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """([random, ordinary] pair counts, [random, ordinary] numbers of tokens) of some texts."""
    values, plain = [], []
    for t, spans in zip(texts, base_spans(texts)):
        if spans:
            values += [v for v in (value_of(t, s) for s in spans) if re.search(rb"[0-9]", v) and re.search(rb"[A-Za-z]", v)]
            t = bytearray(t)
            for s, _, e in spans:
                t[s:e] = b" " * (e - s)
            t = bytes(t)
        plain.append(t)
    random, _ = pair_counts(np.frombuffer(b" " + b" ".join(values) + b" ", np.uint8), 1)
    ordinary, n = np.zeros(SIZE * SIZE, np.int64), 0
    for buf, *_ in buffers(plain):
        counts, tokens = pair_counts(buf, TRAIN_LENGTH)
        ordinary += counts
        n += tokens
    return np.stack([random, ordinary]), np.array([len(values), n])


@dataclass(frozen=True)
class RandomnessModel:
    """ratio: log-likelihood ratio (random to ordinary) of each pair of classes; threshold: what a
    token's sum must exceed."""

    ratio: np.ndarray
    threshold: float

    @classmethod
    def of(cls, counts: np.ndarray, tokens: np.ndarray) -> RandomnessModel:
        random, ordinary = counts.reshape(2, SIZE, SIZE).astype(float)
        uniform = 1 / SIZE
        seen = random.sum(axis=1, keepdims=True)
        p = np.where(seen > 0, random / np.maximum(seen, 1), uniform) * (1 - UNIFORM) + uniform * UNIFORM
        q = (ordinary + PRIOR * uniform) / (ordinary.sum(axis=1, keepdims=True) + PRIOR)
        odds = np.log((tokens[1] + 1) / (tokens[0] + 1))
        return cls(np.log(p) - np.log(q), max(0.0, float(odds)) + MARGIN)

    def scores(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        c = CLASS[buf]
        total = np.concatenate([[0.0], np.cumsum(self.ratio[c[:-1], c[1:]])])  # total[i]: pairs up to (i - 1, i)
        return total[end] - total[start - 1]


def found_spans(texts: list[bytes], model: RandomnessModel) -> list[tuple[list[Span], list[Span]]]:
    """(pattern matches, added spans) of each text, in bytes."""
    base = base_spans(texts)
    added: list[list[Span]] = [[] for _ in texts]
    for buf, starts, nos, offset in buffers(texts):
        start, end = runs(CLASS[buf] > 0, MIN_LENGTH)
        letters = np.concatenate([[0], np.cumsum(IS_LETTER[buf])])
        hit = (model.scores(buf, start, end) > model.threshold) & (letters[end] > letters[start])
        for s, e in zip(start[hit], end[hit]):
            k = int(np.searchsorted(starts, s, side="right")) - 1
            at = int(offset[k] + s - starts[k])
            to = at + int(e - s)
            if not any(a < to and at < b for a, _, b in base[nos[k]]):
                added[nos[k]].append((at, 3, to))
    return list(zip(base, added))


def in_code_points(text: bytes, spans: list[Span]) -> list[Span]:
    at, n, point = 0, 0, {}
    for p in sorted({x for s, _, e in spans for x in (s, e)}):
        n += len(text[at:p].decode())
        at, point[p] = p, n
    return [(point[s], k, point[e]) for s, k, e in spans]


def fit(texts: DataFrame, text_col: str = "text") -> RandomnessModel:
    """The models of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, tokens = np.zeros((2, SIZE * SIZE), np.int64), np.zeros(2, np.int64)
        for b in batches:
            c, t = sample_counts(byte_texts(b.column(0)))
            counts += c
            tokens += t
        flat = np.concatenate([counts.reshape(-1), tokens])
        at = np.flatnonzero(flat)
        yield pa.record_batch({"at": pa.array(at, pa.int64()), "n": pa.array(flat[at], pa.int64())})

    total = np.zeros(2 * SIZE * SIZE + 2, np.int64)
    parts = bounded_batches(texts).select(F.col(f"`{text_col}`")).mapInArrow(count, "at long, n long")
    for at, n in parts.groupBy("at").agg(F.sum("n")).collect():  # a table of fixed size
        total[at] = n
    return RandomnessModel.of(total[:-2].reshape(2, -1), total[-2:])


def scan(texts: DataFrame, model: RandomnessModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row, spans): for each row of ``texts`` its kept columns (all, if None) as a struct and its spans,
    array of (kind, start, end)."""
    keep = texts.columns if keep is None else keep
    slim = bounded_batches(texts).select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(f"`{text_col}`").alias("text"))
    schema = StructType([slim.schema["row"], *StructType.fromDDL("spans array<struct<kind: string, start: bigint, end: bigint>>")])
    arrow = to_arrow_schema(schema)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = byte_texts(b.column("text"))
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in in_code_points(t, sorted(base + more))]
                     for t, (base, more) in zip(texts, found_spans(texts, model))]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(spans, arrow.field("spans").type)], names=["row", "spans"])

    return slim.mapInArrow(find, schema)

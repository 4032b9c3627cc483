"""Removal of long repeated passages, found over a prefix-free parse of the corpus.

A byte goes if it is covered by a string of ``width`` bytes that also starts earlier in the
corpus (smaller id, or the same document and an earlier start); overlaps count.

Method.  A rolling hash over ``GRAM`` bytes triggers phrases: window p (the ``width`` bytes at p)
belongs to the phrase that starts at the leftmost smallest hash among its first ``span``
positions.  This depends on the window's own bytes only, so equal windows sit at the same place
of an equal phrase.  A phrase with all bytes that its windows reach is a dictionary word
(``full``); the bytes that every such window holds are its stem (``core``).

1. The parse of each batch (a range of ids, hence a stretch of corpus order) sends its distinct
   stems, once each, with the word if the batch has only one.  A stem that has one word in the
   whole corpus settles all its windows: the first use stays, later ones are repeats.
2. Only phrases whose stem has several words, those at the edges of repeated passages, are
   resolved window by window.  Each batch builds the suffix array of the dictionary of their words;
   with the parse, which gives the first place of each word, it puts the windows in corpus order.
   The first of each goes to the owner of its hash, again one row for each distinct window and batch.
3. Every batch marks and removes the bytes of its repeated windows.

A window never leaves its phrase's word, so suffixes are sorted to a depth of ``width`` bytes and
the parse to a depth of one phrase; stems that are not shared need no order at all.  Batches follow
the corpus order, so theirs are merged by (batch, place) in groups of equal stems and windows.
What is shuffled is a few bytes for each phrase, of which there are two in every ``span`` bytes or
so; a stem, word or window that a third of all rows share is one entry for each batch.  Within a
batch windows are compared by their bytes; between batches by 96 bits of hash, stems and words by 128.

Defined results: a null text is empty; texts shorter than ``width`` stay whole; a null id sorts
first; rows with one id are ordered by text, and of equal rows the first is kept.  An id whose rows
hold more than a batch gets batches of its own, to which its rows are dealt before they are ordered.
An empty table gives an empty result.  Other columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orisite.llm.common import PIECE_BYTES, Rolling, bounded_batches, byte_texts, byte_values, checkpointed, free_names, mix64, pack, quoted

GRAM = 16
VALUES, CHECK_VALUES = byte_values(10), byte_values(110)
#: Bytes of text in a batch, about.
BATCH_BYTES = 4 << 20
#: What a row takes in a batch besides its text, about.
ROW_BYTES = 64
#: Where null ids are in the order.
LEAST_ID = -(1 << 63)
FIRST, REPEAT, EDGE = 0, 1, 2
RESULTS = ["n_bytes", "n_removed", "n_spans", "kept", "kept_text", "kept_sha256"]


# ---------------------------------------------------------------------------- the parse

def minima(key: np.ndarray, span: int) -> np.ndarray:
    """For each p: the leftmost position of the smallest key in [p, p + span)."""
    n = len(key) - span + 1
    if n <= 0:
        return np.empty(0, np.int64)
    blocks = -(-len(key) // span)
    bits = np.uint32(max(1, (span - 1).bit_length()))
    low = np.uint32((1 << int(bits)) - 1)
    k = np.full(blocks * span, np.uint32((1 << 32) - 1))
    k[: len(key)] = key | low
    k = k.reshape(blocks, span)
    k &= ~low | np.arange(span, dtype=np.uint32)  # leftmost among equals, within a block
    base = np.repeat(np.arange(blocks, dtype=np.int64) * span, span)
    left = np.minimum.accumulate(k[:, ::-1], axis=1)[:, ::-1].reshape(-1)[:n]
    right = np.minimum.accumulate(k, axis=1).reshape(-1)[span - 1: span - 1 + n]
    in_left = (left >> bits) <= (right >> bits)
    return np.where(in_left, base[:n] + (left & low), base[span - 1: span - 1 + n] + (right & low))


def suffix_array(text: np.ndarray, place: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): the ascending places sorted by the ``depth`` bytes from each, equal ones by place,
    and which of the sorted differ from the one before.  Ranks by 8 bytes are doubled to the largest
    power below the depth; two that overlap make up the rest, so bytes are compared, not hashes."""

    def pair(rank: np.ndarray, by: int) -> np.ndarray:
        key = rank.astype(np.uint64) << np.uint64(32)
        key[: len(rank) - by] |= rank[by:]
        return key

    def ranked(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        sorted_ = key[order]
        rank = np.empty(len(key), np.uint32)
        rank[order] = np.cumsum(np.concatenate([[False], sorted_[1:] != sorted_[:-1]]), dtype=np.uint32)
        return rank

    if not len(place):
        return np.empty(0, np.int64), np.empty(0, bool)
    key = np.zeros(len(text), np.uint64)
    for i in range(8):
        key <<= np.uint64(8)
        key[: len(text) - i] |= text[i:]
    rank, known = ranked(key), 8
    while 2 * known <= depth:
        rank = ranked(pair(rank, known))
        known *= 2
    key = pair(rank, depth - known)[place]
    order = np.argsort(key, kind="stable")
    key = key[order]
    return order, np.concatenate([[True], key[1:] != key[:-1]])


class Parse:
    """The phrases of a batch, in corpus order.

    text    all bytes of the batch's documents, one after the other
    bounds  where each document starts, and the end
    lo, hi  first and last window start of each phrase
    core, full  hashes of its stem and its word
    """

    def __init__(self, texts: list[bytes], width: int, span: int):
        if width < GRAM + span - 1:
            raise ValueError("the width must hold span + GRAM - 1 bytes")
        self.width, self.span = width, span
        self.text = np.frombuffer(b"".join(texts), np.uint8)
        self.bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.rolling = Rolling(min(len(self.text), PIECE_BYTES) + 2 * (width + span))
        found = [self._piece(*x) for x in self._stretches()]
        self.lo, self.hi, self.core, self.full = (
            np.concatenate([np.empty(0, t), *c]) if found else np.empty(0, t)
            for t, c in zip((np.int64, np.int64, np.uint64, np.uint64), zip(*found) if found else ((),) * 4))

    def _stretches(self) -> Iterator[tuple[int, int]]:
        """Window starts [a, b) to be handled at once: whole documents, or parts of a long one."""
        a = 0
        for s, e in zip(self.bounds, self.bounds[1:]):
            if e - a > PIECE_BYTES and s > a:
                yield a, int(s)
                a = int(s)
            while e - a > PIECE_BYTES:
                yield a, a + PIECE_BYTES
                a += PIECE_BYTES
        if len(self.text) > a:
            yield a, len(self.text)

    def _hashes(self, a: int, b: int, values: np.ndarray = VALUES) -> np.ndarray:
        return self.rolling.prefix(values[self.text[a:b]])

    def _piece(self, a: int, b: int):
        width, span = self.width, self.span
        end = min(len(self.text), b + width + span)
        h = self._hashes(a, end)
        key = (h[GRAM:] - h[:-GRAM]) * self.rolling.down[: max(0, end - a - GRAM + 1)]
        key *= np.uint64(0x9E3779B97F4A7C15)
        top = minima((key >> np.uint64(32)).astype(np.uint32), span)
        # a window must end within its document
        first, last = np.searchsorted(self.bounds, [a, b - 1], side="right") - 1
        ok = np.zeros(b - a, bool)
        doc = np.zeros(b - a, np.int64)
        for d in range(first, last + 1):
            s, e = max(self.bounds[d], a), min(self.bounds[d + 1] - width + 1, b)
            if e > s:
                ok[s - a: e - a] = True
                doc[s - a: e - a] = d
        p = np.flatnonzero(ok)
        if not len(p):
            return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),) * 2
        m, d = top[p], doc[p]
        new = np.ones(len(p), bool)
        new[1:] = (m[1:] != m[:-1]) | (d[1:] != d[:-1])
        i = np.flatnonzero(new)
        lo, hi, m = p[i], p[np.append(i[1:], len(p)) - 1], m[i]
        core = self.rolling.of(h, m, m + width - span + 1)
        full = self.rolling.of(h, lo, hi + width)
        full = mix64(full ^ ((m - lo).astype(np.uint64) << np.uint64(32)) ^ (hi - lo).astype(np.uint64))
        return lo + a, hi + a, core, full

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Every window of the chosen phrases, in suffix order: (start, whether it is the first with its
        bytes, hash, 32 bits of a second hash).  Windows of equal bytes are in corpus order."""
        lo, hi = self.lo[chosen], self.hi[chosen]
        n = hi - lo + 1
        start = np.repeat((lo - np.concatenate([[0], np.cumsum(n)[:-1]])).astype(np.int32), n)
        start += np.arange(len(start), dtype=np.int32)
        out, check = np.empty(len(start), np.uint64), np.empty(len(start), np.uint32)
        for a, b in self._stretches():
            i, j = np.searchsorted(start, [a, b])
            if j > i:
                end, at = min(len(self.text), b + self.width), start[i:j] - a
                out[i:j] = self.rolling.of(self._hashes(a, end), at, at + self.width)
                check[i:j] = self.rolling.of(self._hashes(a, end, CHECK_VALUES), at, at + self.width) >> np.uint64(32)
        # the words as they lie in the text, where neighbours overlap; a window never leaves its word
        covered = np.zeros(len(self.text) + 1, np.int32)
        np.add.at(covered, lo, 1)
        np.add.at(covered, hi + self.width, -1)
        covered = np.cumsum(covered[:-1], dtype=np.int32) > 0
        place = (np.cumsum(covered, dtype=np.int32) - 1)[start] if len(start) else start
        order, first = suffix_array(self.text[covered], place, self.width)
        return start[order], first, out[order], check[order]

    def stems(self):
        """What the batch asks about its stems: ``core`` distinct, ``word`` (0: several), and for
        each phrase ``stem``, the number of its core, ``again``: an earlier phrase of the batch
        has the same word."""
        core, stem = np.unique(self.core, return_inverse=True)
        order = np.lexsort((self.full, self.core))
        c, f = self.core[order], self.full[order]
        same = np.zeros(len(order), bool)
        same[1:] = (c[1:] == c[:-1]) & (f[1:] == f[:-1])  # lexsort is stable: the first is the earliest
        again = np.zeros(len(order), bool)
        again[order] = same
        several = np.bincount(stem[~again], minlength=len(core)) > 1
        word = np.zeros(len(core), np.uint64)
        word[stem] = self.full | np.uint64(1)  # zero is kept for: several
        word[several] = 0
        return core, word, stem, again


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def split(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions) of the buckets that occur; positions ascend."""
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cut) if len(order) else ():
        yield int(bucket[part[0]]), part


# ------------------------------------------------------------------------------ the rounds

def first_batch(keys: list[np.ndarray], batch: np.ndarray) -> np.ndarray:
    """For each row whether no row of an earlier batch has the same keys."""
    order = np.lexsort((batch, *keys))
    same = np.ones(max(0, len(order) - 1), bool)
    for k in keys:
        same &= k[order][1:] == k[order][:-1]
    out = np.ones(len(order), bool)
    out[order[1:]] = ~same
    return out


def _sorted_batch(t: pa.Table) -> tuple[pa.Table, list[bytes]]:
    texts = byte_texts(t.column("text"))
    ids = t.column("doc_id").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i]))
    return t.select(["batch", "__row"]).take(pa.array(order, pa.int64())), [texts[i] for i in order]


def _rows(kind: int, batch: int, key: np.ndarray, word: np.ndarray, buckets: int) -> Iterator[dict]:
    for b, at in split(bucket_of(key, buckets)):
        yield {"bucket": b * 2 + kind, "batch": batch, "core": pack(key[at]), "word": pack(word[at])}


ASKED = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("core", pa.binary()), ("word", pa.binary())])
ANSWER = pa.schema([("batch", pa.int64()), ("kind", pa.int64()), ("bucket", pa.int64()), ("flags", pa.binary())])
ASKED_SQL, ANSWER_SQL = "bucket long, batch long, core binary, word binary", "batch long, kind long, bucket long, flags binary"


def ask_stems(t: pa.Table, width: int, span: int, buckets: int) -> pa.Table:
    core, word, _, _ = Parse(_sorted_batch(t)[1], width, span).stems()
    return pa.Table.from_pylist(list(_rows(0, t.column("batch")[0].as_py(), core, word, buckets)), ASKED)


def answer(t: pa.Table) -> pa.Table:
    """For one bucket: whether each stem, or each window, is the first, a repeat or an edge."""
    t = t.sort_by("batch")
    batches = t.column("batch").to_pylist()
    cores = [np.frombuffer(x.as_py(), np.uint64) for x in t.column("core")]
    kind = t.column("bucket")[0].as_py() % 2
    key, batch = np.concatenate(cores), np.repeat(batches, [len(c) for c in cores])
    if kind == 1:
        check = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in t.column("word")])
        flags = np.where(first_batch([check, key], batch), FIRST, REPEAT)
    else:
        word = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in t.column("word")])
        order = np.lexsort((word, key))
        k, w = key[order], word[order]
        start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        edge = np.zeros(len(k), bool)  # a stem with several words, here or within one batch
        n = np.diff(np.append(start, len(k)))
        edge[order] = np.repeat((w[start] != w[start + n - 1]) | (w[start] == 0), n)
        known = first_batch([word, key], batch)
        flags = np.where(~known & (word != 0), REPEAT, np.where(edge, EDGE, FIRST))
    cuts = np.cumsum([len(c) for c in cores])[:-1]
    rows = [{"batch": b, "kind": kind, "bucket": t.column("bucket")[0].as_py() // 2, "flags": pack(f.astype(np.uint8))}
            for b, f in zip(batches, np.split(flags, cuts))]
    return pa.Table.from_pylist(rows, ANSWER)


def _read(answers: pa.Table, kind: int, key: np.ndarray, buckets: int) -> np.ndarray:
    got = {r["bucket"]: r["flags"] for r in answers.to_pylist() if r["kind"] == kind}
    flags = np.empty(len(key), np.uint8)
    for b, at in split(bucket_of(key, buckets)):
        flags[at] = np.frombuffer(got[b], np.uint8)
    return flags


def _phrase_flags(parse: Parse, answers: pa.Table, buckets: int) -> np.ndarray:
    core, _, stem, again = parse.stems()
    return np.where(again, REPEAT, _read(answers, 0, core, buckets)[stem])


def ask_windows(t: pa.Table, answers: pa.Table, width: int, span: int, buckets: int) -> pa.Table:
    if not t.num_rows:
        return ASKED.empty_table()
    parse = Parse(_sorted_batch(t)[1], width, span)
    _, new, h, check = parse.windows(_phrase_flags(parse, answers, buckets) == EDGE)
    return pa.Table.from_pylist(list(_rows(1, t.column("batch")[0].as_py(), h[new], check[new], buckets)), ASKED)


def repeated(texts: list[bytes], answers: pa.Table, width: int, span: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(mask of the removed bytes of the batch's concatenated texts, bounds of the texts)."""
    parse = Parse(texts, width, span)
    flags = _phrase_flags(parse, answers, buckets)
    change = np.zeros(len(parse.text) + 1, np.int32)
    whole = flags == REPEAT
    np.add.at(change, parse.lo[whole], 1)
    np.add.at(change, parse.hi[whole] + width, -1)
    start, new, h, _ = parse.windows(flags == EDGE)  # new: the first of the batch, may still be a repeat
    gone = ~new
    gone[new] = _read(answers, 1, h[new], buckets) == REPEAT
    gone = start[gone]
    np.add.at(change, gone, 1)
    np.add.at(change, gone + width, -1)
    return np.cumsum(change[:-1], dtype=np.int32) > 0, parse.bounds


def remove_batch(t: pa.Table, answers: pa.Table, width: int, span: int, buckets: int, with_text: bool) -> pa.Table:
    out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept", "kept_text", "kept_sha256")}
    if t.num_rows:
        t, texts = _sorted_batch(t)
        gone, bounds = repeated(texts, answers, width, span, buckets)
        for s, e, text in zip(bounds, bounds[1:], texts):
            g = gone[s:e]
            n = int(g.sum())
            kept = text if not n else np.frombuffer(text, np.uint8)[~g].tobytes()
            out["n_bytes"].append(len(text))
            out["n_removed"].append(n)
            out["n_spans"].append(int(np.count_nonzero(g[1:] & ~g[:-1]) + (len(g) > 0 and bool(g[0]))))
            out["kept"].append(kept if with_text else None)
            out["kept_text"].append(kept.decode("utf-8", "ignore") if with_text else None)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
    types = dict(n_bytes=pa.int64(), n_removed=pa.int64(), n_spans=pa.int64(), kept=pa.binary(),
                 kept_text=pa.string(), kept_sha256=pa.string())
    return pa.table({"__row": t.column("__row"), **{k: pa.array(v, types[k]) for k, v in out.items()}})


def cut_ids(slim: DataFrame, batch_bytes: int) -> tuple[list[int], dict[int, int]]:
    """(bounds, pieces): the last id of each batch of about ``batch_bytes``, and into how many batches the
    rows of an id go that hold more than one.  Ids are summed, sorted in ranges and their bytes added up;
    at most three values for each batch reach the driver."""
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES)
    ids = slim.groupBy(F.coalesce("doc_id", F.lit(LEAST_ID)).alias("id")).agg(size.alias("size"), F.count("*").alias("rows"))
    ids = checkpointed(ids.repartitionByRange("id").withColumn("part", F.spark_partition_id()))
    parts = ids.groupBy("part").agg(F.sum("size").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    upto = Window.partitionBy("part").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("size").over(upto) + F.col("offset")
    placed = ids.join(F.broadcast(offsets), "part").withColumn("end", end)
    crosses = F.floor(F.col("end") / batch_bytes) > F.floor((F.col("end") - F.col("size")) / batch_bytes)
    hot = (F.col("size") > batch_bytes) & (F.col("rows") > 1)
    bounds, pieces = set(), {}
    for i, n, is_hot in placed.where(crosses | hot).select("id", "size", hot).collect():
        bounds.add(i)
        if is_hot:
            pieces[i] = -(-n // batch_bytes)
            bounds |= {i - 1} if i > LEAST_ID else set()
    return sorted(bounds), pieces


def remove_repeats(docs: DataFrame, width: int = 100, span: int = 64, batch_bytes: int = BATCH_BYTES,
                   with_text: bool = True, id_col: str = "doc_id", text_col: str = "text",
                   keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all but the text, if None) and, last, n_bytes, n_removed, n_spans,
    kept, kept_text and kept_sha256 (with underscores added to a name that a kept column has): one row
    for each row of ``docs``.  ``kept`` holds the remaining
    bytes and ``kept_text`` those of whole characters (both null without ``with_text``).

    Batches are ranges of ids of about ``batch_bytes``, cut by a running sum of bytes; the bounds (8
    bytes a batch) are all that passes the driver.  Rows of an id that fills several batches are written
    with the numbers by which they are dealt, so that all reads agree.
    """
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.struct(*quoted(keep)).alias("__row"))
    row_type = slim.schema["__row"]
    bounds, pieces = cut_ids(slim, batch_bytes)
    key, no = F.coalesce("doc_id", F.lit(LEAST_ID)), F.lit(0).cast("long")
    if pieces:
        is_hot = key.isin(list(pieces))
        hot = checkpointed(slim.where(is_hot).withColumn("no", F.monotonically_increasing_id()))
        slim = slim.where(~is_hot).withColumn("no", no).unionByName(hot)
    else:
        slim = slim.withColumn("no", no)
    most = max(pieces.values(), default=1)
    hot_ids = np.asarray(sorted(pieces), np.int64)
    hot_pieces = np.asarray([pieces[i] for i in sorted(pieces)], np.uint64)

    @F.pandas_udf("long")
    def batch_of(ids: pd.Series, nos: pd.Series) -> pd.Series:
        i = ids.to_numpy(np.int64)
        batch = np.searchsorted(np.asarray(bounds, np.int64), i) * most
        if len(hot_ids):
            at = np.minimum(np.searchsorted(hot_ids, i), len(hot_ids) - 1)
            piece = mix64(nos.to_numpy(np.int64).astype(np.uint64)) % hot_pieces[at]
            batch += np.where(hot_ids[at] == i, piece.astype(np.int64), 0)
        return pd.Series(batch)

    batched = slim.withColumn("batch", batch_of(key, F.col("no")) if bounds else no).drop("no")
    by_batch = bounded_batches(batched).groupBy("batch")
    buckets = -(-(len(bounds) + 1 + sum(pieces.values())) // 2)
    asked = by_batch.applyInArrow(lambda t: ask_stems(t, width, span, buckets), ASKED_SQL)
    stems = asked.groupBy("bucket").applyInArrow(answer, ANSWER_SQL)
    edges = by_batch.cogroup(stems.groupBy("batch")).applyInArrow(
        lambda t, a: ask_windows(t, a, width, span, buckets), ASKED_SQL)
    windows = edges.groupBy("bucket").applyInArrow(answer, ANSWER_SQL)
    result = (StructType([row_type]).add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long")
              .add("kept", "binary").add("kept_text", "string").add("kept_sha256", "string"))
    removed = by_batch.cogroup(stems.unionByName(windows).groupBy("batch")).applyInArrow(
        lambda t, a: remove_batch(t, a, width, span, buckets, with_text), result)
    return removed.select("__row.*", *(F.col(n).alias(free) for n, free in zip(RESULTS, free_names(RESULTS, keep))))

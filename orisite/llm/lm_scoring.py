"""Language-model scores from a weighted backoff automaton.

N-grams of the training texts are counted and smoothed with a Dirichlet prior of weight ``mass`` on
the shorter context: p(w | h) = (c(hw) + mass * p(w | h')) / (c(h) + mass), and
p(w) = (c(w) + 1) / (N + V + 1).  Seen contexts are the states.  A seen n-gram is an arc to the
state of its longest known suffix; a state's failure arc leads to its own suffix with weight
mass / (c(h) + mass).  One left-to-right traversal of each text carries the state and adds up the
logarithms of the arcs taken.

The model grows with the corpus, so no task holds it whole: a batch of texts asks for the counts
of its distinct n-grams, each once, dealt out by hash; the owners add them up over all batches and
answer; the batch builds the part of the automaton that its texts can reach and traverses them, in
step, all texts at their t-th token at once.  A frequent word or n-gram is one entry for each batch.
Rows are dealt to batches by id and text; where equal rows would fill a batch, they are scored as one
text with its number of rows and told apart again in the result.  N-grams are told apart by 64 bits of hash.

Defined results: A-Z is lower-cased; tokens are the words ``[^\\x20\\x09-\\x0D]+`` and one end; a null
text is empty and has the end alone; rows count and are scored each, repeated or not; without
training rows N and V are 0 and every token has probability 1.  An empty table gives an empty
result.  Only the id, the text and the training mark are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orisite.llm.common import Rolling, batch_count, bounded_batches, byte_texts, byte_values, mix64, pack, word_hashes
from orisite.llm.suffix_dedup import bucket_of, split

VALUES = byte_values(2, lower=True)
START, END = np.uint64(1), np.uint64(2)
#: Bytes of text in a batch, about.
BATCH_BYTES = 16 << 20
#: What a row takes in a batch besides its text, about.
ROW_BYTES = 64
ORDER, MASS = 2, 1000.0
ASKED = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
ANSWER = pa.schema([("batch", pa.int64()), ("bucket", pa.int64()), ("counts", pa.binary())])


class Grams:
    """The n-grams of a batch of texts.

    at      where each text's start symbol is in the token sequence; n: its tokens, end included
    number  for each length, the number of the n-gram that ends at each token (-1: none)
    keys    for each length, the hash of each n-gram
    first   for each length, a token at which each n-gram ends
    """

    def __init__(self, texts: list[bytes], order: int):
        h, doc = word_hashes(texts, VALUES, Rolling(1 << 19))
        words = np.bincount(doc, minlength=len(texts))
        self.n = words + 1
        self.at = np.concatenate([[0], np.cumsum(words + 2)])[:-1]
        gram = np.full(len(h) + 2 * len(texts), END)
        gram[self.at] = START
        doc = 2 * doc + 1
        doc += np.arange(len(h), dtype=doc.dtype)
        gram[doc] = h
        del h, doc  # large: a batch and its temporaries must fit in a worker
        self.text = np.repeat(np.arange(len(texts), dtype=np.int32), words + 2)
        self.number, self.keys, self.first = [], [], []
        self._number(gram, np.ones(len(gram), bool))
        tokens, valid = gram, np.ones(len(gram), bool)
        for _ in range(1, order):
            longer = np.zeros(len(tokens), np.uint64)
            longer[1:] = gram[:-1]
            longer *= np.uint64(0x9E3779B97F4A7C15)
            longer += tokens
            gram = mix64(longer)
            valid = np.concatenate([[False], valid[:-1]])
            valid &= tokens != START
            self._number(gram, valid)

    def _number(self, gram: np.ndarray, valid: np.ndarray) -> None:
        place = np.flatnonzero(valid).astype(np.int32)
        place = place[np.argsort(gram[place])]
        sorted_ = gram[place]
        new = np.ones(len(place), bool)
        new[1:] = sorted_[1:] != sorted_[:-1]
        self.keys.append(sorted_[new])
        self.first.append(place[new])
        del sorted_
        of = np.full(len(gram), -1, np.int32)
        of[place] = np.cumsum(new, dtype=np.int32) - 1
        self.number.append(of)

    def counts(self, times: np.ndarray) -> list[np.ndarray]:
        """How often each n-gram occurs, with each text counted so many times."""
        out, once = [], times.max(initial=0) <= 1
        within = times[self.text]
        for of, k in zip(self.number, self.keys):
            here = (within > 0) & (of >= 0)
            out.append(np.bincount(of[here], None if once else within[here], minlength=len(k)).astype(np.int64))
        return out


class BackoffAutomaton:
    """The states and arcs that a batch's texts can reach, with base-10 logarithms as weights."""

    def __init__(self, grams: Grams, counts: list[np.ndarray], n: int, v: int, mass: float):
        self.grams, self.counts, self.order = grams, counts, len(counts)
        p = [(counts[0] + 1) / (n + v + 1)]
        self.failure = []
        for j in range(1, self.order):
            end = grams.first[j]
            context, suffix = grams.number[j - 1][end - 1], grams.number[j - 1][end]
            p.append((counts[j] + mass * p[j - 1][suffix]) / (counts[j - 1][context] + mass))
            self.failure.append(np.log10(mass / (counts[j - 1] + mass)))
        self.arc = [np.log10(x) for x in p]

    def traverse(self) -> np.ndarray:
        """The log-probability of each text.  The state after a token is the longest known n-gram
        that ends there, at most order - 1 long; ``level`` is its length."""
        g, order = self.grams, self.order
        by_length = np.argsort(-g.n, kind="stable")
        at, n = g.at[by_length], g.n[by_length]
        total = np.zeros(len(at))
        level = np.zeros(len(at), np.int8)
        if order > 1 and len(at):
            level[:] = self.counts[0][g.number[0][at]] > 0
        steps = int(n[0]) if len(n) else 0
        alive = np.searchsorted(-n, -np.arange(1, steps + 1), side="right")
        for t, k in enumerate(alive.tolist(), 1):
            token = at[:k] + t
            for j in range(order, 0, -1):
                here = np.flatnonzero(level[:k] == j - 1) if order > 1 else np.arange(k)
                if not len(here):
                    continue
                arc = g.number[j - 1][token[here]]
                seen = self.counts[j - 1][arc] > 0
                if j == 1:
                    total[here] += self.arc[0][arc]
                    level[here] = np.where(seen & (order > 1), -1, -100)  # marks of those that have moved on
                else:
                    go = here[seen]
                    total[go] += self.arc[j - 1][arc[seen]]
                    level[go] = -min(j, order - 1)
                    back = here[~seen]
                    total[back] += self.failure[j - 2][g.number[j - 2][token[back] - 1]]
                    level[back] = j - 2
            moved = level[:k]
            level[:k] = np.where(moved == -100, 0, -moved)
        out = np.empty(len(at))
        out[by_length] = total
        return out


def pack_counts(c: np.ndarray) -> bytes:
    """One byte for each count; 255 stands for a larger one, which follows in eight bytes."""
    return pack(np.minimum(c, 255).astype(np.uint8)) + pack(c[c >= 255].astype(np.int64))


def unpack_counts(b: bytes, n: int) -> np.ndarray:
    c = np.frombuffer(b, np.uint8, n).astype(np.int64)
    c[c == 255] = np.frombuffer(b, np.int64, offset=n)
    return c


def _ask(batch: int, keys: list[np.ndarray], counts: list[np.ndarray], buckets: int) -> Iterator[dict]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    for b, at in split(bucket_of(mix64(key), buckets).astype(np.int32)):
        yield {"bucket": b, "batch": batch, "keys": pack(key[at]), "counts": pack_counts(count[at])}


def answer(t: pa.Table) -> pa.Table:
    """For one bucket: the counts of each row's keys, added up over all batches."""
    keys = [np.frombuffer(x.as_py(), np.uint64) for x in t.column("keys")]
    counts = np.concatenate([unpack_counts(x.as_py(), len(k)) for x, k in zip(t.column("counts"), keys)])
    _, number = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(number, counts).astype(np.int64)
    parts = np.split(total[number], np.cumsum([len(k) for k in keys])[:-1])
    return pa.Table.from_pylist([{"batch": b, "bucket": t.column("bucket")[0].as_py(), "counts": pack_counts(c)}
                                 for b, c in zip(t.column("batch").to_pylist(), parts)], ANSWER)


def fold_copies(slim: DataFrame, batch_bytes: int) -> DataFrame:
    """``slim`` with the column ``times``.  Equal rows (id, text and mark) of a kind that holds more than
    a batch become one row with their number, in a sum of partial sums; all other rows count once.  There
    are at most as many such kinds as batches."""
    key = F.xxhash64("doc_id", "text")
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES)
    kinds = slim.groupBy(key.alias("key")).agg(size.alias("size"), F.count("*").alias("rows"))
    heavy = [r[0] for r in kinds.where((F.col("size") > batch_bytes) & (F.col("rows") > 1)).select("key").collect()]
    if not heavy:
        return slim.withColumn("times", F.lit(1).cast("long"))
    is_heavy = key.isin(heavy)
    folded = slim.where(is_heavy).groupBy("doc_id", "text", "train").agg(F.count("*").alias("times"))
    return slim.where(~is_heavy).withColumn("times", F.lit(1).cast("long")).unionByName(folded)


def unfold_copies(scored: DataFrame) -> DataFrame:
    """As many rows as ``times`` says, in two steps, so that no array is long."""
    one, step = F.lit(1).cast("long"), 1 << 16
    many = scored.withColumn("part", F.explode(F.sequence(one, F.ceil(F.col("times") / step))))
    rest = F.least(F.lit(step), F.col("times") - (F.col("part") - 1) * step)
    return many.withColumn("part", F.explode(F.sequence(one, rest))).drop("part", "times")


def training_size(docs: DataFrame, buckets: int) -> tuple[int, int]:
    """(tokens, distinct tokens) of all texts (text, times); the distinct are found where their hash is dealt."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = byte_texts(b.column("text"))
            if texts:
                g = Grams(texts, 1)
                key = g.keys[0][g.keys[0] != START]
                rows = [{"bucket": b, "n": 0, "keys": pack(key[at])} for b, at in split(bucket_of(mix64(key), buckets))]
                rows[0]["n"] = int((g.n * b.column("times").to_numpy()).sum())
                yield pa.RecordBatch.from_pylist(rows, schema)

    def size(t: pa.Table) -> pa.Table:
        keys = np.unique(np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in t.column("keys")]))
        return pa.table({"n": [sum(t.column("n").to_pylist())], "v": [len(keys)]})

    schema = pa.schema([("bucket", pa.int64()), ("n", pa.int64()), ("keys", pa.binary())])
    asked = docs.select("text", "times").mapInArrow(ask, "bucket long, n long, keys binary")
    n, v = asked.groupBy("bucket").applyInArrow(size, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    return n or 0, v or 0


def score_texts(docs: DataFrame, train: Column, order: int = ORDER, mass: float = MASS, batch_bytes: int = BATCH_BYTES,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score) of every row; ``train``
    marks the rows that the model learns from."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       F.coalesce(train, F.lit(False)).alias("train"))
    slim = fold_copies(bounded_batches(slim), batch_bytes)
    batches = batch_count(slim, "text", batch_bytes)
    n, v = training_size(slim.where("train"), batches)
    by_batch = slim.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches))).groupBy("batch")

    def read(t: pa.Table) -> Grams:
        return Grams(byte_texts(t.column("text")), order)  # the bytes are let go of here

    def ask(t: pa.Table) -> pa.Table:
        g = read(t)
        counts = g.counts(np.where(t.column("train"), t.column("times"), 0))
        return pa.Table.from_pylist(list(_ask(t.column("batch")[0].as_py(), g.keys, counts, batches)), ASKED)

    def score(t: pa.Table, answers: pa.Table) -> pa.Table:
        out = {"doc_id": t.column("doc_id"), "train": t.column("train"), "times": t.column("times")}
        if t.num_rows:
            g = read(t)
            got = dict(zip(answers.column("bucket").to_pylist(), answers.column("counts").to_pylist()))
            key = np.concatenate(g.keys)
            total = np.empty(len(key), np.int64)
            for b, at in split(bucket_of(mix64(key), batches)):
                total[at] = unpack_counts(got[b], len(at))
            counts = np.split(total, np.cumsum([len(k) for k in g.keys])[:-1])
            model = BackoffAutomaton(g, counts, n, v, mass)
            size = t.num_rows
            known, log_p = (counts[0] > 0).astype(np.int32), model.arc[0].copy()
            start = np.searchsorted(g.keys[0], START)  # stands in each sequence, but is no token
            known[start] = log_p[start] = 0
            known = np.add.reduceat(known[g.number[0]], g.at).astype(np.int64)
            base = np.add.reduceat(log_p[g.number[0]], g.at)
            out |= {"n_tokens": g.n, "n_known": known, "train_tokens": np.full(size, n), "base_score": base,
                    "score": model.traverse()}
        else:
            out |= {k: pa.array([], pa.int64()) for k in ("n_tokens", "n_known", "train_tokens")}
            out |= {k: pa.array([], pa.float64()) for k in ("base_score", "score")}
        return pa.table(out)

    id_type = slim.schema["doc_id"].dataType.simpleString()
    asked = by_batch.applyInArrow(ask, "bucket long, batch long, keys binary, counts binary")
    answers = asked.groupBy("bucket").applyInArrow(answer, "batch long, bucket long, counts binary")
    scored = by_batch.cogroup(answers.groupBy("batch")).applyInArrow(
        score, f"doc_id {id_type}, train boolean, times long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return unfold_copies(scored)

"""Language identification by word-first backoff.

A known word adds its logarithmic frequency in each language.  An unseen word falls back to its
character n-grams: each of its places takes the longest known n-gram that ends there, from
``LONGEST`` characters down to one, and the word adds the mean over its places.  The language with
the largest sum wins; the score is its share in the softmax of the sums.

Words are runs of letters of any plane of Unicode, without regard to case, framed by one boundary
for their n-grams.  The model is fitted on a bounded sample: of each language about ``per_lang`` of its
distinct rows (id and text), drawn by a hash of both, or all if there are no more.  All words and
n-grams of the sample are kept; a caller may keep only the ``max_entries`` most frequent of each
length, split evenly over the languages, and others then fall back like any unseen word.

Defined results: ``und`` with score 0 for a null or empty text, one without a letter, and if
nothing was learned; ties go to the language that sorts first; texts with a null language are not
learned from, equal rows are learned from once.  Rows are judged each, repeated or not.  Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orisite.llm.common import Rolling, all_characters, bounded_batches, byte_texts, mix64, pieces, within

PER_LANG = 1_000
LONGEST = 4
#: Languages that are broadcast at most.
BROADCAST_LANGS = 100_000
#: Added to every count.
SMOOTHING = 0.1
UNKNOWN = "und"


class Letters:
    """For each character: a value for hashing, equal for both cases and for all that is no letter;
    whether it is a letter.  Made once in each task."""

    def __init__(self):
        every = all_characters()
        low, self.letter = np.zeros(len(every), np.uint64), np.strings.isalpha(every)
        for c in np.flatnonzero(self.letter).tolist():
            low[c] = ord(x) if len(x := chr(c).lower()) == 1 else c
        self.value = mix64(low + np.uint64(11)) | np.uint64(1)
        self.rolling = Rolling(1 << 19)


class Words:
    """The words of one piece: where they start and end, their hash and their document."""

    def __init__(self, nos: list[int], parts: list[bytes], of: Letters):
        texts = [p.decode("utf-8", "replace") for p in parts]
        c = np.frombuffer((" " + " ".join(texts) + "  ").encode("utf-32-le", "replace"), np.uint32)
        edge = np.flatnonzero(np.diff(of.letter[c].view(np.int8)))
        self.start, self.end = edge[::2] + 1, edge[1::2] + 1
        self.rolling, self.h = of.rolling, of.rolling.prefix(of.value[c])
        self.hash = self.rolling.of(self.h, self.start, self.end)
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.doc = np.asarray(nos, np.int64)[np.searchsorted(ends, self.start - 1, side="right")]

    def places(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the chosen words' letters and closing boundary: (number of the word, place, room)
        with room for the characters up to there, the opening boundary included."""
        start, n = self.start[chosen], (self.end - self.start)[chosen] + 1
        word = np.repeat(np.arange(len(start)), n)
        inside = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
        return word, start[word] + inside, inside + 2

    def gram(self, place: np.ndarray, length: int) -> np.ndarray:
        """Hash of the ``length`` characters that end at each place."""
        return self.rolling.of(self.h, place + 1 - length, place + 1) ^ np.uint64(length)


@dataclass
class LanguageModel:
    langs: list[str]
    keys: list[np.ndarray]  # words, then n-grams of 1, 2, ... characters; sorted
    logs: list[np.ndarray]  # a row for each key, a column for each language

    def find(self, kind: int, h: np.ndarray) -> np.ndarray:
        keys = self.keys[kind]
        if not len(keys):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, at, -1)


def count_sample(sample: DataFrame, longest: int) -> DataFrame:
    """(lang, kind, gram, n): kind 0 for words, else the n-gram's length."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Letters()
        for b in batches:
            langs = np.asarray(b.column("lang").to_pylist(), object)
            texts = byte_texts(b.column("text"))
            for lang in sorted(set(langs)):
                found: dict[int, list[np.ndarray]] = {k: [] for k in range(longest + 1)}
                for nos, parts in pieces([t for t, l in zip(texts, langs) if l == lang]):
                    w = Words(nos, parts, of)
                    found[0].append(w.hash)
                    _, place, room = w.places(np.arange(len(w.start)))
                    for k in range(1, longest + 1):
                        found[k].append(w.gram(place[room >= k], k))
                for kind, hs in found.items():
                    key, n = np.unique(np.concatenate(hs), return_counts=True)
                    yield pa.record_batch({"lang": pa.array([lang] * len(key), pa.string()), "kind": pa.array([kind] * len(key), pa.int32()),
                                           "gram": pa.array(key.view(np.int64)), "n": pa.array(n)})

    return (bounded_batches(sample).select("lang", "text").mapInArrow(count, "lang string, kind int, gram long, n long")
            .groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n")))


def fit(docs: DataFrame, per_lang: int = PER_LANG, longest: int = LONGEST, max_entries: int | None = None,
        id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn from the rows of ``docs`` whose language is not null."""
    known = docs.where(F.col(lang_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    known = known.withColumn("row", F.xxhash64(F.lit(4), "id", "text"))
    sizes = known.groupBy("lang", "row").agg(F.lit(1)).groupBy("lang").agg(F.count("*").alias("n_docs"))
    langs = sizes.count()
    if not langs:
        return LanguageModel([], [], [])
    draw = F.shiftrightunsigned("row", 11) / F.lit(float(1 << 53))
    sample = (known.join(within(sizes, langs, BROADCAST_LANGS), "lang").where(draw * F.col("n_docs") < per_lang)
              .dropDuplicates(["lang", "row"]))
    counts = count_sample(sample, longest)
    totals = Window.partitionBy("lang", "kind")
    entries = counts.withColumn("total", F.sum("n").over(totals))
    if max_entries is not None:
        # the ranking is of pre-aggregated entries, by language and kind; its limit is pushed below the shuffle
        best = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "gram")
        entries = entries.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= max(1, max_entries // langs)).drop("rank")
    kept = entries.toPandas()  # of the bounded sample
    names = sorted(kept["lang"].unique())
    model = LanguageModel(names, [], [])
    for kind in range(longest + 1):
        part = kept[kept["kind"] == kind]
        keys = np.unique(part["gram"].to_numpy(np.int64).view(np.uint64))
        n = np.zeros((len(keys), len(names)))
        total = np.ones(len(names))
        row = np.searchsorted(keys, part["gram"].to_numpy(np.int64).view(np.uint64))
        col = np.searchsorted(names, part["lang"].to_numpy(str)) if len(part) else np.empty(0, int)
        n[row, col] = part["n"]
        total[col] = part["total"]
        model.keys.append(keys)
        model.logs.append(np.log((n + SMOOTHING) / (total + SMOOTHING * (len(keys) + 1))).astype(np.float32))
    return model


def add_up(rows: np.ndarray, group: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows of each group; groups ascend."""
    out = np.zeros((size, rows.shape[1]))
    if len(rows):
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        out[group[first]] = np.add.reduceat(rows, first, axis=0, dtype=np.float64)
    return out


def log_likelihoods(texts: list[bytes], model: LanguageModel, of: Letters) -> tuple[np.ndarray, np.ndarray]:
    """(sum for each text and language, whether the text has a word)."""
    total = np.zeros((len(texts), len(model.langs)))
    some = np.zeros(len(texts), bool)
    for nos, parts in pieces(texts):
        w = Words(nos, parts, of)
        some[w.doc] = True
        at = model.find(0, w.hash)
        known = at >= 0
        total += add_up(model.logs[0][at[known]], w.doc[known], len(texts))
        unseen = np.flatnonzero(~known)
        word, place, room = w.places(unseen)
        value = np.zeros((len(word), len(model.langs)), np.float32)
        left = np.arange(len(word))
        for k in range(len(model.keys) - 1, 0, -1):
            fits = left[room[left] >= k]
            at = model.find(k, w.gram(place[fits], k))
            hit = at >= 0
            value[fits[hit]] = model.logs[k][at[hit]]
            done = np.zeros(len(word), bool)
            done[fits[hit]] = True
            left = left[~done[left]]
        mean = add_up(value, word, len(unseen)) / (w.end - w.start + 1)[unseen][:, None]
        total += add_up(mean, w.doc[unseen], len(texts))
    return total, some


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, if None) with ``lang_pred`` and ``lang_score``."""
    row = F.struct(*(docs.columns if keep is None else keep)).alias("__row")
    slim = docs.select(row, F.col(text_col).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Letters()
        for b in batches:
            texts = byte_texts(b.column("text"))
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if model.langs and texts:
                total, some = log_likelihoods(texts, model, of)
                best = total.argmax(axis=1)
                score = np.where(some, 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1), 0.0)
                lang = [model.langs[i] if s else UNKNOWN for i, s in zip(best, some)]
            yield pa.record_batch({"__row": b.column("__row"), "lang_pred": pa.array(lang, pa.string()), "lang_score": pa.array(score, pa.float64())})

    schema = StructType([slim.schema["__row"]]).add("lang_pred", "string").add("lang_score", "double")
    return bounded_batches(slim).mapInArrow(scan, schema).select("__row.*", "lang_pred", "lang_score")

"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities and counts of lexicon words in four tiers, their proximity to
second-person words, and the rates of capitals, punctuation and obfuscated spellings.  One tier is a
short list of insults; three are learned: words and word beginnings that labelled toxic texts have
and others do not, by strength (log-likelihood ratio).

The labelled sample (about ``max_rows`` distinct rows, id and text, at most: ids are drawn by a hash,
and rows once more if ids repeat) is divided in
three: the lexicon is learned on one part, the trees on the second and the calibration on the
third, so that each step sees how the one before does on texts that it has not seen.  What is
learned has a fixed size; the sample's ids are the only thing that is broadcast.

Defined results: a null text is empty; an empty text has all features 0 and gets the score of
these; a label of a missing or null id, and a null label, are not used; of several labels of an id
the largest counts.  Without labelled rows of both classes every score is the share of toxic rows
(0 without rows).  Rows with equal ids are scored each.  Other columns pass through, whatever their names.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from orisite.llm.common import Rolling, all_characters, bounded_batches, byte_texts, checkpointed, free_names, mix64, pieces, quoted, within

INSULTS = ("idiot", "idiots", "moron", "morons", "stupid", "dumb", "loser", "losers", "pathetic", "worthless",
           "disgusting", "trash", "scum", "clown", "fool", "jerk", "creep", "liar", "coward", "filth", "vermin",
           "hate", "ugly", "useless", "garbage", "shut", "kill", "die")
SECOND_PERSON = ("you", "your", "yours", "yourself", "ya", "u", "ur", "tu", "te", "toi", "ton", "ta", "tes", "vous",
                 "votre", "vos", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tú", "ti", "usted", "ustedes",
                 "vosotros", "vuestro")
#: Digits and signs that stand for letters.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: Word beginnings that may enter the lexicon, in characters; 0 is the whole word.
STEMS = (0, 3, 4, 5, 6, 7)
#: Learned entries in each tier.
TIERS = (16, 64, 256)
#: Least log-likelihood gain of an entry: chance alone gives one in e^10 terms as much.
LEAST_GAIN = 10.0
NEAR = 5
MAX_ROWS = 20_000
FEATURES = ("words", "hits_fixed", "hits_1", "hits_2", "hits_3", "density_fixed", "density_1", "density_2", "density_3",
            "hidden_hits", "near_second", "second", "capitals", "capital_words", "punctuation", "shouts", "obfuscated", "runs")


# ----------------------------------------------------------------------------- the features

class Characters:
    """For each character a value for hashing (equal for both cases, for stand-ins and for the
    styled letters above U+FFFF, as in mathematics), whether it is a letter, whether it is a capital.
    Made once in each task."""

    def __init__(self):
        every = all_characters()
        low, self.letter, self.upper = np.arange(len(every), dtype=np.uint64), np.strings.isalpha(every), np.strings.isupper(every)
        for c in np.flatnonzero(self.letter | self.upper).tolist():
            s = chr(c) if c <= 0xFFFF else unicodedata.normalize("NFKC", chr(c))
            if len(x := s.lower()) == 1:
                low[c] = ord(x)
        for a, b in STAND_INS.items():
            low[ord(a)] = ord(b)
        self.value = mix64(low + np.uint64(3)) | np.uint64(1)
        self.rolling = Rolling(1 << 19)


class Tokens:
    """The words of one piece of text: maximal runs of letters and digits, with @ and $ between
    letters.  Hashes see capitals as small letters and stand-ins as what they stand for."""

    def __init__(self, parts: list[bytes], of: Characters):
        value, letter, upper = of.value, of.letter, of.upper
        self.rolling = of.rolling
        self.ends = np.cumsum([len(p.decode("utf-8", "replace")) + 1 for p in parts])
        text = b" " + b" ".join(parts) + b" "
        c = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        self.chars, self.letter, self.upper = c, letter[c], upper[c]
        digit = (c >= 48) & (c <= 57)
        sign = (c == ord("@")) | (c == ord("$"))
        sign[1:-1] &= self.letter[:-2] & self.letter[2:]
        own = self.letter | digit | sign
        edge = np.flatnonzero(np.diff(own.view(np.int8)))
        start, end = edge[::2] + 1, edge[1::2] + 1
        letters = np.concatenate([[0], np.cumsum(self.letter)])
        n = letters[end] - letters[start]
        some = n > 0
        self.start, self.end, self.n_letters = start[some], end[some], n[some]
        capital = np.concatenate([[0], np.cumsum(self.upper)])
        self.n_upper = capital[self.end] - capital[self.start]
        self.h = self.rolling.prefix(value[c])

    def stem(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, valid) of the first ``length`` characters of each word; 0: of all."""
        size = self.end - self.start
        end = self.end if length == 0 else np.minimum(self.start + length, self.end)
        h = self.rolling.of(self.h, self.start, end) ^ np.uint64(length)
        return h, (size > 2) if length == 0 else (size > length)


def word_keys(words: tuple[str, ...], of: Characters) -> np.ndarray:
    t = Tokens([w.encode() for w in words], of)
    return np.unique(t.rolling.of(t.h, t.start, t.end))


def found(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Position of each hash in the sorted keys, or -1."""
    if not len(keys):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, at, -1)


def features(texts: list[bytes], lexicon: tuple[np.ndarray, np.ndarray], of: Characters) -> np.ndarray:
    """One row of ``FEATURES`` for each text.  lexicon: sorted hashes and the tier of each."""
    keys, tier = lexicon
    fixed, second = word_keys(INSULTS, of), word_keys(SECOND_PERSON, of)
    names = {k: i for i, k in enumerate(("chars", "letters", "upper", "punct", "shouts", "runs", "words", "caps", "odd", "second",
                                         "hit0", "hit1", "hit2", "hit3", "hidden", "near"))}
    total = np.zeros((len(names), len(texts)))
    for nos, parts in pieces(texts):
        t = Tokens(parts, of)
        nos = np.asarray(nos)
        size = len(texts)

        def add(name: str, positions: np.ndarray) -> None:
            doc = nos[np.minimum(np.searchsorted(t.ends, positions - 1, side="right"), len(nos) - 1)]
            total[names[name]] += np.bincount(doc, minlength=size)

        c = t.chars
        ascii_mark = ((c > 32) & (c < 48)) | ((c > 57) & (c < 65)) | ((c > 90) & (c < 97)) | ((c > 122) & (c < 127))
        add("chars", np.flatnonzero(c > 32))
        add("letters", np.flatnonzero(t.letter))
        add("upper", np.flatnonzero(t.upper))
        add("punct", np.flatnonzero(ascii_mark))
        add("shouts", np.flatnonzero((c == 33) | (c == 63)))
        add("runs", 2 + np.flatnonzero((c[2:] == c[1:-1]) & (c[1:-1] == c[:-2]) & (c[2:] > 32)))
        add("words", t.start)
        add("caps", t.start[(t.n_upper == t.n_letters) & (t.n_letters > 1)])
        odd = t.n_letters < t.end - t.start
        add("odd", t.start[odd])
        whole = t.rolling.of(t.h, t.start, t.end)
        is_second = found(second, whole) >= 0
        add("second", t.start[is_second])
        best = np.full(len(whole), len(TIERS) + 1)
        for length in STEMS:
            h, valid = t.stem(length)
            at = found(keys, h)
            best = np.where(valid & (at >= 0), np.minimum(best, tier[at] if len(tier) else 9), best)
        in_fixed = found(fixed, whole) >= 0
        add("hit0", t.start[in_fixed])
        for k in range(1, len(TIERS) + 1):
            add(f"hit{k}", t.start[best == k])
        hit = np.flatnonzero(in_fixed | (best <= len(TIERS)))
        add("hidden", t.start[hit[odd[hit]]])
        if is_second.any() and len(hit):
            s = np.flatnonzero(is_second)
            doc = np.searchsorted(t.ends, t.start - 1, side="right")
            after = np.searchsorted(s, hit)
            near = np.zeros(len(hit), bool)
            for one in (s[np.minimum(after, len(s) - 1)], s[np.maximum(after - 1, 0)]):
                near |= (np.abs(one - hit) <= NEAR) & (doc[one] == doc[hit])
            add("near", t.start[hit[near]])
    v = {k: total[i] for k, i in names.items()}
    words, chars, letters = (np.maximum(v[k], 1) for k in ("words", "chars", "letters"))
    hits = [v[f"hit{k}"] for k in range(4)]
    return np.column_stack([np.log1p(v["words"]), *map(np.log1p, hits), *(h / words for h in hits),
                            np.log1p(v["hidden"]), np.log1p(v["near"]), v["second"] / words, v["upper"] / letters,
                            v["caps"] / words, v["punct"] / chars, v["shouts"] / chars, v["odd"] / words, v["runs"] / chars])


def terms(texts: list[bytes], of: Characters) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of the distinct stems and words of each text."""
    hs, ds = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for nos, parts in pieces(texts):
        t = Tokens(parts, of)
        doc = np.asarray(nos)[np.searchsorted(t.ends, t.start - 1, side="right")]
        for length in STEMS:
            h, valid = t.stem(length)
            hs.append(h[valid])
            ds.append(doc[valid])
    h, d = np.concatenate(hs), np.concatenate(ds)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], d[new]


# -------------------------------------------------------------------------------- the model

@dataclass
class ToxicityModel:
    lexicon: tuple[np.ndarray, np.ndarray]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    constant: float = 0.0


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int, id_col: str, text_col: str,
                    label_col: str) -> DataFrame:
    """(part, label, text) of about ``max_rows`` distinct labelled rows at most; part is 0, 1 or 2."""
    one = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
           .groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("double").alias("label")))
    n = one.count()
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(3), "__id"), 11) / F.lit(float(1 << 53))
    drawn = one.where(draw < F.lit(max_rows / max(n, 1)))
    part = F.when(F.pmod(F.xxhash64(F.lit(5), "__id"), F.lit(5)) < 2, 0).when(F.pmod(F.xxhash64(F.lit(5), "__id"), F.lit(5)) < 4, 1).otherwise(2)
    drawn = within(drawn.withColumn("part", part), min(n, max_rows), 2 * max_rows)
    rows = (docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(drawn, "__id")
            .withColumn("row", F.xxhash64(F.lit(7), "__id", "text")))
    # an id may stand for any number of rows
    size = rows.groupBy("row").agg(F.lit(1)).count()
    if size > max_rows:
        rows = rows.where(F.shiftrightunsigned("row", 11) / F.lit(float(1 << 53)) < F.lit(max_rows / size))
    return checkpointed(rows.select("row", "part", "label", "text").dropDuplicates(["row"]).drop("row"))


def learn_lexicon(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the learned entries and the tier (1, 2, ...) of each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Characters()
        for b in batches:
            h, d = terms(byte_texts(b.column("text")), of)
            toxic = np.asarray(b.column("label").to_pylist(), float)[d] > 0 if len(d) else np.empty(0, bool)
            key, at = np.unique(h, return_inverse=True)
            yield pa.record_batch({"term": pa.array(key.view(np.int64)), "toxic": pa.array(np.bincount(at, toxic, len(key))),
                                   "clean": pa.array(np.bincount(at, ~toxic, len(key)))})

    texts = sample.where("part = 0").select("label", "text").distinct()  # copies would count as support
    size = texts.agg(F.count_if(F.col("label") > 0), F.count_if(F.col("label") <= 0)).first()
    if not size[0] or not size[1]:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    nt, nc = map(float, size)
    per = bounded_batches(texts).mapInArrow(count, "term long, toxic double, clean double").groupBy("term").agg(
        F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    t, c = F.col("t"), F.col("c")
    expected = (t + c) * (nt / (nt + nc))
    gain = t * F.ln(F.greatest(t, F.lit(0.5)) / expected) + c * F.ln(F.greatest(c, F.lit(0.5)) / (t + c - expected))
    best = (per.where((t >= 3) & (t / nt > 8 * (c / nc))).withColumn("gain", gain).where(F.col("gain") >= LEAST_GAIN)
            .orderBy(F.desc("gain"), "term").limit(sum(TIERS)).select("term").collect())  # a fixed number of entries
    keys = np.array([r[0] for r in best], np.int64).view(np.uint64)
    tier = np.repeat(np.arange(1, len(TIERS) + 1), TIERS)[: len(keys)]
    order = np.argsort(keys)
    return keys[order], tier[order]


def with_features(df: DataFrame, lexicon: tuple[np.ndarray, np.ndarray], inside: str | None = None) -> DataFrame:
    """``df`` with its column ``text`` replaced by ``features``, a vector; or with ``features`` of the
    field ``inside`` of its column ``__row``, which stays."""
    rest = [f for f in df.schema.fields if f.name != "text"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Characters()
        for b in batches:
            text = b.column("text") if inside is None else b.column("__row").field(inside)
            x = features(byte_texts(text), lexicon, of)
            flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.reshape(-1)))
            yield pa.record_batch({**{f.name: b.column(f.name) for f in rest}, "features": flat})

    schema = StructType([*rest, StructField("features", ArrayType(DoubleType()))])
    return bounded_batches(df).mapInArrow(scan, schema).withColumn("features", array_to_vector("features"))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic") -> ToxicityModel:
    """Learn from the texts of ``docs`` that ``labels`` marks 1 (toxic) or 0."""
    sample = labelled_sample(docs, labels, max_rows, id_col, text_col, label_col)
    lexicon = learn_lexicon(sample)
    rows = checkpointed(with_features(sample.where("part > 0"), lexicon))
    share = {r[0]: r[1] for r in rows.groupBy("part").agg(F.collect_set("label")).collect()}
    mean = sample.agg(F.avg(F.least("label", F.lit(1.0)))).first()[0] or 0.0
    if len(share.get(1, [])) < 2:
        return ToxicityModel(lexicon, None, None, float(mean))
    gbt = GBTClassifier(labelCol="label", maxIter=12, maxDepth=3, stepSize=0.3, minInstancesPerNode=3, seed=1, cacheNodeIds=False)
    trees = gbt.fit(rows.where("part = 1").select("label", "features"))
    iso = None
    if len(share.get(2, [])) == 2:
        raw = trees.transform(rows.where("part = 2")).select("label", vector_to_array("probability")[1].alias("p"))
        iso = IsotonicRegression(featuresCol="p", labelCol="label").fit(raw)
    return ToxicityModel(lexicon, trees, iso, float(mean))


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, if None) and, last, ``toxicity`` (with underscores added where a
    kept column has that name), the calibrated chance that the row's text is toxic.  A fiftieth of the trees' own probability is mixed in, so that scores that
    calibrate alike keep their order."""
    keep = docs.columns if keep is None else keep
    slim = docs.select(F.struct(*quoted(keep)).alias("__row"), *([] if text_col in keep else [F.col(f"`{text_col}`").alias("text")]))
    if model.trees is None:
        done = slim.withColumn("toxicity", F.lit(model.constant))
    else:
        done = (model.trees.transform(with_features(slim, model.lexicon, text_col if text_col in keep else None))
                .select("__row", vector_to_array("probability")[1].alias("p")))
        if model.calibration is not None:
            done = model.calibration.setFeaturesCol("p").setPredictionCol("iso").transform(done)
            done = done.withColumn("p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.98 * F.col("iso") + 0.02 * F.col("p"))))
        done = done.withColumn("toxicity", F.col("p"))
    return done.select("__row.*", F.col("toxicity").alias(free_names(["toxicity"], keep)[0]))

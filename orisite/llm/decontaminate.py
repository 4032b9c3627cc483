"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item leaks into a document if at least ``threshold`` of the item's distinct word shingles
occur in it.  Documents are partitioned by size: one with up to 2^c shingles gets a one-permutation
MinHash of ``2^c * BINS`` bins, the smallest shingle hash of each bin.  Bins in proportion to the
size keep the containment of a short item visible in a document of any length, where bins of
one number for all sizes would lose it.  Items whose shingles cannot fill the threshold in a
document of that size are pruned; items that meet a bin's minimum are candidates; candidates are
verified by the exact containment of their shingles as strings.

A shared shingle is shadowed by a smaller hash in its bin with a chance of about 1 / (2 * BINS) or
less, and all of an item's shared shingles must be for it to be missed: under 1e-10 where the
threshold asks for seven or more (items of eight shingles on).  Shorter items would be missed more
often, 3 % of those of one shingle; they are met with every shingle of the documents instead, so
none is missed.  Without such items that second pass is left out.

Only DataFrame functions are used.  The sketch is an array made within the row, so documents are
not shuffled; the items' shingles are broadcast if a count finds few, else joined by shuffle.

Defined results: texts are lower-cased; words are ``[^\\x20\\x09-\\x0D]+``; a text of fewer than
``shingle`` words is one shingle of all of them, so such an item only leaks into an equal text.  A
null or blank item or document matches nothing.  Repeated items are found each; rows of one id are
judged apart by their text and equal rows give one pair.  Null ids are kept as such.  Empty tables
give no pairs.  Only ids and texts are read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orisite.llm.common import checkpointed, let, within

SHINGLE, THRESHOLD = 5, 0.8
#: Bins for each shingle of the largest document of a size class.
BINS = 16
#: Shared shingles from which the sketch alone is safe; items that leak with fewer are met with all.
SAFE = 7
#: Item shingles that are broadcast at most (some 20 MB).
BROADCAST_ROWS = 200_000


def split_words(text: Column) -> Column:
    """Lower-cased words of a text; empty for a null or blank one."""
    return let(F.lower(F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))), lambda t: F.when(
        t != "", F.split(t, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>")))


def windows(words: Column, shingle: int, joined: Callable[..., Column], kind: str) -> Column:
    """``joined`` of each run of ``shingle`` neighbours; of all words, if they are fewer (the places
    beyond the end are null, which ``joined`` leaves out)."""
    return F.when(F.size(words) > 0, F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(words) - shingle, F.lit(0))),
        lambda i: joined(*(F.get(words, i + j) for j in range(shingle))))).otherwise(F.array().cast(f"array<{kind}>"))


def shingle_hashes(text: Column, shingle: int) -> Column:
    """Hashes of a text's shingles, in order, repeats included."""
    return let(F.transform(split_words(text), lambda w: F.xxhash64(w)), lambda h: windows(h, shingle, F.xxhash64, "bigint"))


def shingle_texts(text: Column, shingle: int) -> Column:
    """The distinct shingles of a text."""
    return let(split_words(text), lambda w: F.array_distinct(windows(w, shingle, lambda *g: F.concat_ws(" ", *g), "string")))


def sketch(hashes: Column) -> Column:
    """One-permutation MinHash: of the sorted hashes, the first of each bin (its top bits)."""
    def of(s: Column) -> Column:
        bits = F.ceil(F.log2(F.greatest(F.size(s), F.lit(1)))).cast("int") + F.lit(BINS.bit_length() - 1)
        return let(F.lit(64) - bits, lambda drop: F.filter(s, lambda x, i: (i == 0) | (
            F.call_function("shiftrightunsigned", x, drop)
            != F.call_function("shiftrightunsigned", F.get(s, i - 1), drop))))
    return let(F.sort_array(hashes), of)


def leaks(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD,
          id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, item_id, n_common, n_item, containment) of every pair with a containment
    of at least ``threshold``."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    i = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("item")).distinct()
    grams = i.select("item_id", F.xxhash64("item").alias("item_hash"), shingle_texts(F.col("item"), shingle).alias("g"))
    grams = grams.select("item_id", "item_hash", F.size("g").alias("n_item"), F.explode("g").alias("gram"))
    n = grams.count()
    hashes = i.select("item_id", F.xxhash64("item").alias("item_hash"),
                      F.array_distinct(shingle_hashes(F.col("item"), shingle)).alias("h"))
    hashes = hashes.select("item_id", "item_hash", F.size("h").alias("n_item"), F.explode("h").alias("h"))

    whole = d.select("doc_id", "text_hash", shingle_hashes(F.col("text"), shingle).alias("hs"))

    def met(of_docs: Column, of_items: DataFrame, rows: int) -> DataFrame:
        shown = whole.select("doc_id", "text_hash", F.size("hs").alias("n_doc"), F.explode(of_docs).alias("h"))
        return (shown.join(within(of_items, rows, BROADCAST_ROWS), "h").where(F.col("n_doc") >= F.col("n_item") * threshold)
                .select("doc_id", "text_hash", "item_id", "item_hash"))

    short = F.col("n_item") * threshold <= SAFE - 1
    n_short = hashes.where(short).count()
    candidates = met(sketch(F.col("hs")), hashes.where(~short), n)
    if n_short:
        candidates = candidates.unionByName(met(F.col("hs"), hashes.where(short), n_short))
    candidates = candidates.distinct()
    candidates = checkpointed(candidates.withColumnsRenamed({k: f"c_{k}" for k in candidates.columns}))  # read twice

    def same(*names: str) -> Column:
        return reduce(and_, (F.col(k).eqNullSafe(F.col(f"c_{k}")) for k in names))

    held = candidates.select("c_doc_id", "c_text_hash").distinct()
    held = within(held, held.count(), BROADCAST_ROWS)
    suspects = d.join(held, same("doc_id", "text_hash"), "left_semi").dropDuplicates(["doc_id", "text_hash"])
    shared = (suspects.select("doc_id", "text_hash", F.explode(shingle_texts(F.col("text"), shingle)).alias("gram"))
              .join(within(grams, n, BROADCAST_ROWS), "gram")
              .groupBy("doc_id", "text_hash", "item_id", "item_hash", "n_item").agg(F.count("*").alias("n_common")))
    exact = shared.where(F.col("n_common") >= F.col("n_item") * threshold)
    verified = exact.join(candidates, same("doc_id", "text_hash", "item_id", "item_hash"), "left_semi")
    return verified.select("doc_id", "text_hash", "item_id", "n_common", F.col("n_item").cast("long").alias("n_item"),
                           (F.col("n_common") / F.col("n_item")).alias("containment"))


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that no item leaks into."""
    found = leaks(docs, items, id_col=id_col, text_col=text_col, **how)
    found = checkpointed(found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct())
    found = within(found, found.count(), BROADCAST_ROWS)
    return docs.join(found, docs[id_col].eqNullSafe(found["__id"]) & (F.xxhash64(docs[text_col]) == found["__hash"]), "left_anti")

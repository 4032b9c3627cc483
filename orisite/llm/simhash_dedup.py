"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text's fingerprint has bit b set if more than half of its word-shingle hashes have it set.
Two fingerprints within d bits have a common point within ceil(d/2) bits of both, so every
*distinct* fingerprint emits all its variants within that radius, the variants are shuffled,
and fingerprints that meet are verified by their bit distance and linked.

Defined results: A-Z is lower-cased, nothing else; a text with fewer words than the shingle
length is one shingle of all of them; a null, empty or blank text has fingerprint zero and is
linked like any other.  Among the components' rows repeated rows and repeated ids each keep their
row.  A null id keeps its row but never names a component unless all ids of the component are
null.  Dropping near-duplicates decides for each row, by its component, and leaves one row of each,
also of rows with one id, equal rows and rows without an id.  An empty table gives an empty result.
Components are found from the id and the text only, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orisite.llm.common import bounded_batches, byte_texts, checkpointed, connected_components, quoted

SEED = 42
#: Shingles whose bits are counted in one step.
STEP = 1 << 14


def fingerprint(text: bytes, shingle: int) -> int:
    """The 64-bit SimHash of one text, as a signed integer."""
    words = text.lower().split()  # bytes: only A-Z and only ASCII blanks
    if not words:
        return 0
    if len(words) < shingle:
        grams = iter([b" ".join(words)])
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    ones, n = np.zeros(64, np.int64), 0
    while part := b"".join([xxhash.xxh64_digest(g, SEED) for g in islice(grams, STEP)]):
        bits = np.unpackbits(np.frombuffer(part, np.uint8)).reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.uint32)
        n += len(bits)
    return int(np.packbits(ones * 2 > n).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int, names: dict[str, Column], text_col: str = "text") -> DataFrame:
    """(``names``, which are long, and fp): one row for each row of ``docs``."""
    keep = list(names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t, shingle) for t in byte_texts(b.column("text"))]
            yield pa.record_batch({k: b.column(k) for k in keep} | {"fp": pa.array(fps, pa.int64())})

    slim = docs.select(*(c.alias(k) for k, c in names.items()), F.col(text_col).alias("text"))
    return bounded_batches(slim).mapInArrow(scan, ", ".join(f"{k} long" for k in [*keep, "fp"]))


def links(nodes: DataFrame, max_bits: int) -> DataFrame:
    """(a, b): links between the distinct fingerprints ``fp`` of ``nodes`` that join exactly those
    within reach of each other over steps of at most ``max_bits`` bits.

    All fingerprints that emit one variant lie in a ball of 1 + 64 + ... points, so a group is
    bounded whatever the data.  With an even distance its members are pairwise linked, and a link
    from each to the smallest says as much as all pairs; with an odd one the ball is cut into
    those that are near enough to be linked.
    """
    radius = (max_bits + 1) // 2
    masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(64), r)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    emitted = (nodes.select("fp", F.explode(F.array(*map(F.lit, signed))).alias("mask"))
               .select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant")))
    if max_bits % 2 == 0:
        hub = F.min("fp").over(Window.partitionBy("variant"))
        met = emitted.select("fp", hub.alias("hub")).where("fp <> hub")
        pairs = met.select(F.col("fp").alias("a"), F.col("hub").alias("b"))
    else:
        other = emitted.select(F.col("fp").alias("b"), "variant")
        pairs = emitted.select(F.col("fp").alias("a"), "variant").join(other, "variant").where("a > b").select("a", "b")
    return pairs.distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)


def least_of_components(fps: DataFrame, max_bits: int, key: Column) -> tuple[DataFrame, DataFrame]:
    """(fp, root) of each distinct fingerprint and (root, least): the smallest ``key`` of the rows of
    ``fps`` whose fingerprints are reachable over links of at most ``max_bits`` differing bits."""
    nodes = checkpointed(fps.groupBy("fp").agg(F.min(key).alias("first")))
    roots = connected_components(links(nodes, max_bits))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return rooted.select("fp", "root"), rooted.groupBy("root").agg(F.min("first").alias("least"))


def simhash_components(docs: DataFrame, shingle: int, max_bits: int,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest id reachable over links of at
    most ``max_bits`` differing bits, the row's own included."""
    fps = checkpointed(fingerprints(docs, shingle, {"doc_id": F.col(id_col).cast("long")}, text_col))
    rooted, least = least_of_components(fps, max_bits, F.col("doc_id"))
    named = rooted.join(least, "root").select("fp", F.col("least").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def row_names(docs: DataFrame, id_col: str, text_col: str) -> dict[str, Column]:
    """What tells rows apart, in the order of preference: the id, nulls last, the hash of the text and
    that of the whole row (a null is marked beside its column; maps cannot be hashed and are left out)."""
    read = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    id_ = F.col(id_col).cast("long")
    return {"__no_id": id_.isNull().cast("long"), "__id": F.coalesce(id_, F.lit(0).cast("long")),
            "__text": F.xxhash64(text_col), "__row": F.xxhash64(*(x for c in read for x in (c.isNull(), c)))}


def drop_near_duplicates(docs: DataFrame, shingle: int, max_bits: int,
                         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component: the one with the smallest id, rows without an id last;
    of equal ids the one with the smallest text hash, then the smallest row hash.  Equal rows are made
    one before any shuffle, so that their number makes no large task."""
    names = row_names(docs, id_col, text_col)
    fps = checkpointed(fingerprints(docs, shingle, names, text_col))
    _, least = least_of_components(fps, max_bits, F.struct(*names))
    rows = docs.select(F.struct(*quoted(docs.columns)).alias("__all"), *(c.alias(k) for k, c in names.items()))
    once = rows.dropDuplicates(list(names))
    return once.join(least.select("least.*"), list(names), "left_semi").select("__all.*")

"""Helpers shared by the operators: batching, byte buffers, hashing, connected components."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orisite.session import ensure_checkpoint_dir

#: Bytes of text that one vectorised step handles; temporaries are some 60 times as large.
PIECE_BYTES = 1 << 18
WORD = r"[^\x20\x09-\x0D]+"


# --------------------------------------------------------------------------- DataFrame side

def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def dense_index(df: DataFrame, name: str) -> DataFrame:
    """``df``, written, with the column ``name``: 0, 1, 2, ...  A row's place in its partition is
    offset by the sizes of the partitions before it, one row for each partition."""
    kept = checkpointed(df.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("__at", 33)
    sizes = kept.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return (kept.withColumn("__part", part).join(F.broadcast(starts), "__part")
            .withColumn(name, F.col("__start") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__part", "__at", "__start"))


def quoted(names: list[str]) -> list[Column]:
    """Columns by their whole names, dots included."""
    return [F.col(f"`{n}`") for n in names]


def free_names(names: list[str], taken: list[str]) -> list[str]:
    """``names``, with underscores added to those that are taken, in any case."""
    used, out = {t.lower() for t in taken}, []
    for n in names:
        while n.lower() in used:
            n += "_"
        out.append(n)
    return out


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches hold at most 8 MB of rows (or one row): a batch of
    10,000 long texts, the default, would have to fit in a worker several times."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return df


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` names it in a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def within(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """``df``, marked for broadcast if its counted ``rows`` are at most ``limit``; beyond, the join
    is shuffled and adaptive execution splits its hot keys."""
    return F.broadcast(df) if rows <= limit else df


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo ``m``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(m)


def batch_count(docs: DataFrame, text_col: str, batch_bytes: int) -> int:
    """How many batches of about ``batch_bytes`` the texts make; grows with the input."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(1, math.ceil(total / batch_bytes))


def large_star(edges: DataFrame) -> DataFrame:
    sym = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    m = sym.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return sym.join(m, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    m = edges.groupBy("a").agg(F.min("b").alias("m"))
    linked = edges.join(m, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(m.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node reachable over ``edges`` (a, b); nodes without
    an edge to another node have no row.  Alternating large-star and small-star rounds, about
    the logarithm of the longest path many, each cut by a checkpoint; a hub is pre-aggregated
    before its shuffle and its join rows may be split.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, seen = checkpointed(e), None
    while True:
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen or state[0] == 0:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen, e = state, checkpointed(small_star(large_star(e)))


# ------------------------------------------------------------------------------ worker side

def byte_texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The column's texts as UTF-8 bytes; null becomes empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def all_characters() -> np.ndarray:
    """Every code point as a string of one character."""
    return np.arange(sys.maxunicode + 1, dtype=np.uint32).view("U1")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of a splittable generator)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_values(seed: int, lower: bool = False) -> np.ndarray:
    """One pseudo-random odd 64-bit value per byte; with ``lower`` A-Z share those of a-z."""
    v = mix64((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)
    if lower:
        v[65:91] = v[97:123]
    return v


class Rolling:
    """Hashes of any substring of a buffer from prefix sums: sum of value(byte) * base^i."""

    BASE, INVERSE = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)

    def __init__(self, most: int):
        self.grow(most)

    def grow(self, most: int) -> None:
        for name, base in (("up", self.BASE), ("down", self.INVERSE)):
            p = np.full(most + 1, base, np.uint64)
            p[0] = 1
            setattr(self, name, np.multiply.accumulate(p))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        if len(values) >= len(self.up):
            self.grow(len(values) * 2)
        h = np.empty(len(values) + 1, np.uint64)
        h[0] = 0
        np.cumsum(values * self.up[: len(values)], out=h[1:])
        return h

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((prefix[end] - prefix[start]) * self.down[start])


def is_blank() -> np.ndarray:
    b = np.zeros(256, bool)
    b[[0x20, 9, 10, 11, 12, 13]] = True
    return b


def pieces(texts: list[bytes], limit: int = PIECE_BYTES) -> Iterator[tuple[list[int], list[bytes]]]:
    """(document numbers, texts) of about ``limit`` bytes.  A longer text is cut after blanks, so
    no word is split; its parts carry the same number."""
    nos, parts, size = [], [], 0
    for i, t in enumerate(texts):
        at = 0
        while True:
            end = len(t)
            if end - at > limit:
                end = min((k for k in (t.find(c, at + limit) for c in b" \n\t\r\x0b\x0c") if k >= 0), default=len(t))
            nos.append(i)
            parts.append(t[at:end])
            size += end - at
            at = end
            if size >= limit:
                yield nos, parts
                nos, parts, size = [], [], 0
            if at >= len(t):
                break
    if nos:
        yield nos, parts


def word_hashes(texts: list[bytes], values: np.ndarray, rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of its document), in text order; words as in ``WORD``."""
    blank, hs, ds = is_blank(), [np.empty(0, np.uint64)], [np.empty(0, np.int32)]
    for nos, parts in pieces(texts):
        buf = np.frombuffer(b" " + b" ".join(parts) + b" ", np.uint8)
        edge = np.flatnonzero(np.diff(blank[buf].view(np.int8)))
        start, end = edge[::2] + 1, edge[1::2] + 1
        hs.append(rolling.of(rolling.prefix(values[buf]), start, end))
        ends = np.cumsum([len(p) + 1 for p in parts])
        ds.append(np.asarray(nos, np.int32)[np.searchsorted(ends, start - 1, side="right")])
    return np.concatenate(hs), np.concatenate(ds)


def pack(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()

"""Exact top-k inner products over norm-sorted, SVD-rotated vectors.

Vectors are turned into integers, floor(scale * x).  An orthogonal rotation by the right singular
vectors of all of them (from their Gram matrix, dim x dim) moves most of the length to the leading
components.  Candidates are taken by descending length; for a query with k-th best score t so far

* a block whose longest vector cannot reach t (|q| * |x| < t, Cauchy-Schwarz) ends the search;
* a partial sum over the leading components plus the product of the lengths of the rests bounds
  each score from above; candidates whose bound is below t are left out;
* what remains is scored exactly, in integers.

The query set is bounded by its definition and stated, not a join of all with all: query chunks
meet groups of blocks, each pair in a task of bounded size, and each returns at most k rows a query.
Blocks are dealt to the groups in turn, so that every group starts with long vectors.

Defined results: vectors that are null or hold null or non-finite components, or that are not of
the most frequent dimension, take no part; rows are queries and candidates each, whatever their ids: a
row is not its own candidate, one with the same id is; ties go to the smaller id, null ids last; fewer
than k candidates give fewer rows.  Integers must keep every inner product below 2^53, ids must be below
2^63 - 1 (which stands for null inside).  Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orisite.llm.common import checkpointed, pack

#: Vectors in a block, blocks in a group, queries in a chunk.
BLOCK, GROUP_BLOCKS, CHUNK = 2048, 8, 1024
#: Share of the dimensions that the partial sums take.
LEADING = 0.25
SLACK = 1e-6
NO_ID = (1 << 63) - 1


def integer_vectors(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, v: array<long>, norm) of the vectors that take part; a null id is ``NO_ID``."""
    v = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    rows = (vectors.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("id"), v.alias("v")).where("v is not null")
            .where(F.coalesce(F.forall("v", lambda x: x.isNotNull()), F.lit(False)))
            .where(F.forall("v", lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
            .select("id", F.transform("v", lambda x: F.floor(x * scale)).alias("v")))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def gram_matrix(rows: DataFrame, dim: int) -> np.ndarray:
    """The sum of v v^T over all rows; each task returns one dim x dim matrix."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            m = _matrix(b.column("v"), dim)
            total += m.T @ m
        yield pa.record_batch({"i": pa.array(np.repeat(np.arange(dim), dim)), "j": pa.array(np.tile(np.arange(dim), dim)),
                               "x": pa.array(total.reshape(-1))})

    out = np.zeros((dim, dim))
    for i, j, x in rows.select("v").mapInArrow(partial, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x")).collect():
        out[i, j] = x
    return out


def packed(rows: DataFrame, number: Column, size: int, dim: int) -> DataFrame:
    """(no, ids, rows, v): vectors packed into blocks of ``size`` in the order of ``number``."""

    def pack_block(t: pa.Table) -> pa.Table:
        t = t.sort_by([("number", "ascending")])
        v = _matrix(t.column("v"), dim).astype(np.int64)
        small = v.astype(np.int16) if not len(v) or np.abs(v).max() < 1 << 15 else v
        return pa.table({"no": [t.column("no")[0].as_py()], "ids": [pack(t.column("id").to_numpy().astype(np.int64))],
                         "rows": [pack(t.column("row").to_numpy().astype(np.int64))], "v": [pack(small)]})

    placed = rows.select("id", "row", "v", number.alias("number")).withColumn("no", F.floor(F.col("number") / size))
    return placed.groupBy("no").applyInArrow(pack_block, "no long, ids binary, rows binary, v binary")


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``number``: 0, 1, ... in the given order.  Ranges are sorted by themselves and
    offset by the sizes of those before them."""
    parts = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    ranged = checkpointed(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("__at", 33)
    sizes = ranged.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = sizes.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return (ranged.withColumn("__part", part).join(F.broadcast(starts), "__part")
            .withColumn("number", F.col("start") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__part", "__at", "start"))


Vectors = tuple[np.ndarray, np.ndarray, np.ndarray]  # ids, row numbers, vectors


def _unpack(ids: bytes, rows: bytes, v: bytes, dim: int) -> Vectors:
    i = np.frombuffer(ids, np.int64)
    kind = np.int16 if len(v) == len(i) * dim * 2 else np.int64
    return i, np.frombuffer(rows, np.int64), np.frombuffer(v, kind).reshape(len(i), dim).astype(np.float64)


def search(query: Vectors, blocks: list[Vectors], k: int, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query the best k (score, id) among the blocks' other rows, best first; absent ones have
    score -inf.  Blocks must descend by the length of their longest vector for pruning to bite; the
    result does not depend on it."""
    _, q_row, q = query
    lead = max(1, int(len(rotation) * LEADING))
    q_norm = np.linalg.norm(q, axis=1)
    q_lead = q @ rotation[:, :lead]
    q_rest = np.sqrt(np.maximum(q_norm ** 2 - (q_lead ** 2).sum(axis=1), 0))
    best = np.full((len(q), k), -np.inf)
    who = np.full((len(q), k), np.iinfo(np.int64).max)
    for ids, rows_, x in blocks:
        norm = np.linalg.norm(x, axis=1)
        limit = best[:, -1]
        open_ = np.flatnonzero(q_norm * (norm.max() * (1 + SLACK)) + SLACK >= limit)  # a tie may have a smaller id
        if not len(open_):
            continue
        x_lead = x @ rotation[:, :lead]
        x_rest = np.sqrt(np.maximum(norm ** 2 - (x_lead ** 2).sum(axis=1), 0))
        bound = q_lead[open_] @ x_lead.T
        bound += np.outer(q_rest[open_], x_rest)
        bound += SLACK * (1 + np.outer(q_norm[open_], norm))
        near = bound >= limit[open_][:, None]
        at = np.flatnonzero(near.any(axis=0))
        if not len(at):
            continue
        rows = open_[near.any(axis=1)]
        score = np.rint(q[rows] @ x[at].T)
        score[q_row[rows][:, None] == rows_[at][None, :]] = -np.inf
        if score.shape[1] > k:  # ties at the edge are all kept until ids decide
            edge = -np.partition(-score, k - 1, axis=1)[:, k - 1]
            keep = score >= np.maximum(edge, best[rows, -1])[:, None]
        else:
            keep = score >= best[rows, -1][:, None]
        keep &= score > -np.inf
        r, c = np.nonzero(keep)
        s = np.concatenate([best[rows].reshape(-1), score[r, c]])
        i = np.concatenate([who[rows].reshape(-1), ids[at][c]])
        r = np.concatenate([np.repeat(np.arange(len(rows)), k), r])
        order = np.lexsort((i, -s, r))
        r = r[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        top = order[place < k]
        best[rows], who[rows] = s[top].reshape(-1, k), i[top].reshape(-1, k)
    return best, who


def top_k(vectors: DataFrame, queries: Column, k: int, scale: int = 64, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): for each vector that ``queries`` (over id) marks, its k
    best among all others.  Queries with one id have ranks of their own each."""
    out = "query_row long, query_id long, id long, score long"
    rows = integer_vectors(vectors, scale, id_col, vector_col).withColumn("row", F.monotonically_increasing_id())
    dims = checkpointed(rows).withColumn("dim", F.size("v"))
    usual = dims.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if usual is None or usual["dim"] == 0:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, id long, score long")
    dim = usual["dim"]
    rows = dims.where(F.col("dim") == dim).drop("dim")
    values, axes = np.linalg.eigh(gram_matrix(rows, dim))
    rotation = axes[:, ::-1].copy()  # right singular vectors, the longest first
    groups = max(1, -(-usual["n"] // (BLOCK * GROUP_BLOCKS)))
    blocks = packed(numbered(rows, F.desc("norm"), F.asc("id")), F.col("number"), BLOCK, dim)
    blocks = checkpointed(blocks.withColumn("g", F.col("no") % groups))
    asked = numbered(rows.where(F.col("id") != NO_ID).where(queries), F.asc("id"))
    chunks = checkpointed(packed(asked, F.col("number"), CHUNK, dim).withColumnRenamed("no", "chunk"))
    n_chunks = chunks.count()
    if not n_chunks:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, id long, score long")
    left = chunks.select("chunk", "ids", "rows", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"))
    right = blocks.select("g", "no", "ids", "rows", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_chunks - 1).cast("long"))).alias("chunk"))

    def meet(t: pa.Table, b: pa.Table) -> pa.Table:
        empty = pa.table({c: pa.array([], pa.int64()) for c in ("query_row", "query_id", "id", "score")})
        if not t.num_rows or not b.num_rows:
            return empty
        def unpacked(t: pa.Table) -> list[Vectors]:
            return [_unpack(*(x.as_py() for x in r), dim) for r in zip(t.column("ids"), t.column("rows"), t.column("v"))]

        q = unpacked(t)[0]
        b = b.sort_by("no")
        score, who = search(q, unpacked(b), k, rotation)
        r, c = np.nonzero(np.isfinite(score))
        return pa.table({"query_row": q[1][r], "query_id": q[0][r], "id": who[r, c], "score": score[r, c].astype(np.int64)})

    found = left.groupBy("chunk", "g").cogroup(right.groupBy("chunk", "g")).applyInArrow(meet, out)
    rank = Window.partitionBy("query_row").orderBy(F.desc("score"), "id")
    return (found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
            .select("query_id", "rank", F.when(F.col("id") != NO_ID, F.col("id")).alias("id"), "score"))

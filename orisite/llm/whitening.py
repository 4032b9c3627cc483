"""Whitening of embeddings with distributed block matrices.

Entries become integers, floor(scale * c) + shift, so that sums and means are exact.  The *fit list*
holds each distinct integer vector once, numbered densely.  Its centred vectors are the rows of an
MLlib ``IndexedRowMatrix``, turned into a ``BlockMatrix`` of tall blocks; the transpose times the
matrix is the scatter, whose products are cut into groups of blocks on the middle dimension (without
that, MLlib sends all blocks to the one task that owns the one block of the result).  The
eigenvectors of the small scatter are found on the driver, and the block matrix times the whitening
matrix projects all rows.  What passes the driver is dim x dim and one row for each partition.

A vector that a third of all rows share is one row of the fit list; its rows meet their projection in
a join on the vector, whose hot key adaptive execution splits.

Defined results: vectors that are null, hold null or non-finite entries, or have an entry of 2^40 or
more after scaling take no part; an empty vector has no component and gives no row.  Vectors of two
lengths raise ValueError.  Rows with a null or repeated id are rows like others; equal vectors get
equal results.  A component without variance (as with one distinct vector, or fewer than components)
has a null ``whitened``; ``explained`` is null if there is no variance at all, and ``identity_error``,
taken over the components with variance, is then null too.  ``deviation`` is null beyond 38 digits.
An empty table gives an empty result.  Other columns are not read unless kept; a kept one may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orisite.llm.common import checkpointed, dense_index

#: Entries in a block (4 MB of doubles), and blocks whose products one task adds up.
BLOCK_ENTRIES, TASK_BLOCKS = 1 << 19, 8
#: Scaled entries must be below this.
LIMIT = float(1 << 40)
#: Eigenvalues below this share of the largest count as none.
NO_VARIANCE = 1e-12


def integer_vectors(vectors: DataFrame, scale: int, shift: int, vector_col: str, keep: list[str]) -> DataFrame:
    """(row: struct of ``keep``, x: array<long>) of the vectors that take part."""
    kept = F.struct(*(F.col(f"`{c}`") for c in keep))
    v = F.transform(F.col(f"`{vector_col}`"), lambda c: c.cast("double") * scale)
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LIMIT))
    return (vectors.select(kept.alias("row"), v.alias("v")).where(F.coalesce(sound, F.lit(False)) & (F.size("v") > 0))
            .select("row", F.transform("v", lambda c: F.floor(c) + shift).alias("x")))


def _columns(x: pa.Array) -> np.ndarray:
    flat = x.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(x), -1) if len(x) else flat.reshape(0, 0)


def dimension_totals(fit: DataFrame) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(number of vectors, and for each dimension sum, least and largest entry), sums as Python integers."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _columns(b.column("x"))
                d = x.shape[1]
                yield pa.record_batch({"i": pa.array(range(d), pa.int32()), "n": pa.array([len(x)] * d, pa.int64()),
                                       "s": pa.array(x.sum(axis=0)), "lo": pa.array(x.min(axis=0)), "hi": pa.array(x.max(axis=0))})

    parts = fit.select("x").mapInArrow(partial, "i int, n long, s long, lo long, hi long")
    rows = parts.groupBy("i").agg(F.sum("n"), F.sum(F.col("s").cast("decimal(38,0)")), F.min("lo"), F.max("hi")).orderBy("i").collect()
    n, s, lo, hi = ([r[k] for r in rows] for k in (1, 2, 3, 4))
    return n[0] if n else 0, np.array([int(v) for v in s], object), np.array(lo, object), np.array(hi, object)


def deviation(x: str, n: int, sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Column:
    """Sum over dimensions of (n * x - S)^2, exactly: in longs where the extremes show that they hold it."""
    most = sum(max(abs(n * int(a) - int(s)), abs(n * int(b) - int(s))) ** 2 for s, a, b in zip(sums, lo, hi))
    if most < 1 << 62 and max(abs(n * int(v)) for v in (*lo, *hi)) < 1 << 62:
        gaps = F.zip_with(x, F.lit([int(s) for s in sums]), lambda c, s: c * F.lit(n).cast("long") - s)
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda t, g: t + g * g).cast("decimal(38,0)")
    wide = "decimal(38,0)"
    mean = F.lit([int(s) // n for s in sums])
    rest = F.array(*(F.lit(int(s) % n).cast(wide) for s in sums))
    gaps = F.zip_with(F.zip_with(x, mean, lambda c, q: c - q), rest,
                      lambda d, r: F.try_subtract(F.try_multiply(d.cast(wide), F.lit(n).cast(wide)), r).cast(wide))
    return F.aggregate(gaps, F.lit(0).cast(wide), lambda t, g: F.try_add(t, F.try_multiply(g, g)).cast(wide))


def block_matrix(centred: DataFrame, n: int, dim: int) -> BlockMatrix:
    """Blocks of about ``BLOCK_ENTRIES`` entries, all columns wide, from (index, vector: array<double>)."""
    rows = MLUtils.convertVectorColumnsFromML(centred.select("index", array_to_vector("vector").alias("vector")), "vector")
    return IndexedRowMatrix(rows, n, dim).toBlockMatrix(max(1, BLOCK_ENTRIES // dim), dim)


def scatter(m: BlockMatrix) -> np.ndarray:
    """transpose(m) * m, brought to the driver."""
    splits, left = max(1, -(-m.numRowBlocks // TASK_BLOCKS)), m.transpose()
    java = left._java_matrix_wrapper.call("multiply", m._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(java, m.numCols(), m.numCols()).toLocalMatrix().toArray()


def whitening_matrix(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(dim x k matrix, share of the variance of each component, how many have variance), k at most
    ``components``; columns of components without variance are zero."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    some = int((values > max(values[0], 0) * NO_VARIANCE).sum())
    w = np.zeros_like(vectors)
    w[:, :some] = vectors[:, :some] / np.sqrt(values[:some])
    total = float(np.trace(covariance))
    return w, np.maximum(values, 0) / total if total > 0 else np.full(len(values), np.nan), some


def whiten(vectors: DataFrame, components: int = 16, scale: int = 64, shift: int = 1_000_000, vector_col: str = "embedding",
           keep: list[str] | None = None) -> DataFrame:
    """(row, n, deviation, whitened, explained, identity_error): for each row that takes part its kept
    columns as a struct, the size of the fit list, its squared distance from the mean times n^2
    (decimal), the whitened components (array, null where there is no variance), their shares of the
    variance (array) and the largest entry of the whitened covariance minus the identity."""
    spark = vectors.sparkSession
    keep = [c for c in vectors.columns if c != vector_col] if keep is None else keep
    rows = integer_vectors(vectors, scale, shift, vector_col, keep)
    fit = dense_index(rows.select("x").distinct(), "index")
    lengths = fit.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if lengths[0] is None:
        rest = "n bigint, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
        return spark.createDataFrame([], StructType([rows.schema["row"], *StructType.fromDDL(rest)]))
    if lengths[0] != lengths[1]:
        raise ValueError(f"vectors have different lengths, from {lengths[0]} to {lengths[1]}")
    dim = lengths[0]
    n, sums, lo, hi = dimension_totals(fit)
    # x - S / n with the whole part of the mean taken off as integers: no digit is lost to the shift
    whole, rest = [int(s) // n for s in sums], [int(s) % n / n for s in sums]
    centred = F.zip_with(F.zip_with("x", F.lit(whole), lambda c, q: c - q), F.lit(rest), lambda d, r: d.cast("double") - r)
    m = block_matrix(fit.select("index", centred.alias("vector")), n, dim)
    w, explained, some = whitening_matrix(scatter(m) / n, components)
    right = spark.sparkContext.parallelize([((0, 0), Matrices.dense(*w.shape, w.reshape(-1, order="F")))], 1)
    projected = m.multiply(BlockMatrix(right, dim, w.shape[1], dim, w.shape[1]))
    error = np.abs(scatter(projected) / n - np.eye(w.shape[1]))[:some, :some]
    by_row = projected.toIndexedRowMatrix()  # named, since a wrapper lets go of its matrix when it is collected
    found = callMLlibFunc("getIndexedRows", by_row._java_matrix_wrapper._java_model)
    y = vector_to_array("vector")
    if some < w.shape[1]:
        y = F.transform(y, lambda c, i: F.when(i < some, c))
    known = fit.select("index", "x", deviation("x", n, sums, lo, hi).alias("deviation")).join(
        checkpointed(found.select("index", y.alias("whitened"))), "index")
    shares = F.array(*(F.lit(None if np.isnan(e) else float(e)).cast("double") for e in explained))
    return rows.join(known, "x").select(
        "row", F.lit(n).cast("long").alias("n"), "deviation", "whitened", shares.alias("explained"),
        F.lit(float(error.max()) if some else None).cast("double").alias("identity_error"))

"""K1-K3: result tables, published together.

A run writes all its tables under a version of its own and then replaces one small pointer file.
Readers follow the pointer, so they see the tables of one run, whole, whatever happens meanwhile; a run
that fails leaves the pointer and the tables as they were.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

POINTER = "CURRENT.json"


def write_table(df: DataFrame, path: str) -> None:
    """Write Parquet, replacing what was there.  One table only: see ``publish`` for several."""
    df.write.mode("overwrite").parquet(path)


def _files(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _read_pointer(spark: SparkSession, root: str) -> dict | None:
    path, fs = _files(spark, f"{root}/{POINTER}")
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _write(spark: SparkSession, path, fs, text: str) -> None:
    stream = fs.create(path, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def _point(spark: SparkSession, root: str, content: dict) -> None:
    """Replace the pointer in one step: a rename over the old one; where the store has none (object
    stores), a plain write, which such stores show only when it is complete."""
    jvm, text = spark.sparkContext._jvm, json.dumps(content)
    path, fs = _files(spark, f"{root}/{POINTER}")
    fresh, _ = _files(spark, f"{root}/_{POINTER}.{uuid.uuid4().hex}")
    _write(spark, fresh, fs, text)
    over = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    over[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    try:
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    except Exception as e:  # a Java error
        if "UnsupportedFileSystem" not in str(e):
            raise
        _write(spark, path, fs, text)
        fs.delete(fresh, False)
        return
    context.rename(fs.makeQualified(fresh), fs.makeQualified(path), over)


def publish(spark: SparkSession, out: str, tables: dict[str, DataFrame]) -> dict[str, str]:
    """K1 + K2: write ``tables`` as the new version of the results under ``out`` (a shared folder) and
    point to it; returns their paths.  The version before stays, for readers that still have it open;
    older ones go."""
    root = out.rstrip("/")
    before = _read_pointer(spark, root)
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    folder = f"{root}/versions/{version}"
    try:
        for name, df in tables.items():
            df.write.parquet(f"{folder}/{name}")
    except BaseException:
        path, fs = _files(spark, folder)
        fs.delete(path, True)
        raise
    _point(spark, root, {"version": version, "tables": list(tables)})
    path, fs = _files(spark, f"{root}/versions")
    for found in fs.listStatus(path):
        if before and found.getPath().getName() < before["version"]:
            fs.delete(found.getPath(), True)
    return {name: f"{folder}/{name}" for name in tables}


def result_paths(spark: SparkSession, out: str) -> dict[str, str]:
    """The paths of the published tables under ``out``, all of one version."""
    root = out.rstrip("/")
    now = _read_pointer(spark, root)
    if now is None:
        raise FileNotFoundError(f"nothing is published under {root}")
    return {name: f"{root}/versions/{now['version']}/{name}" for name in now["tables"]}


def read_results(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(path) for name, path in result_paths(spark, out).items()}

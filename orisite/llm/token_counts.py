"""Token counts by a separator scan over flat, unindexed token files.

A token file is nothing but token ids of two or four bytes, little endian, one document after the
other, each closed by the end-of-document id.  Files are cut into blocks; in each block one
vectorised comparison finds the separators.  What a block cannot know, where the document began
that its first separator closes, comes from a prefix scan over the summaries of the blocks before
it: the sum of their lengths and the last separator seen.  A document may span any number of
blocks.

``write_token_files`` makes such files with a public tokenizer.  It may put a header of a few
tokens before each document that spells its id in digits below the end-of-document id, so a flat
file needs no index to say whose tokens it holds.

Defined results: a null or empty text has no tokens; an empty file has no documents; tokens after
a file's last separator are one document that has not ``ended``; bytes that fill no token at the end
of a file are left out.  Repeated rows are counted each; a null id stays null.  One file is read as
one row, so files are written with at most ``docs_per_file`` documents.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orisite.llm.common import bounded_batches, byte_texts
from orisite.session import ensure_checkpoint_dir

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that cuts a text before byte-pair merges; fixed by the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256
#: Header digits that spell any 64-bit id in base END, and null.
DIGITS = 5
BLOCK_TOKENS = 1 << 18
DOCS_PER_FILE = 4096


def header(doc_id: int | None, end: int, digits: int) -> list[int]:
    n = 0 if doc_id is None else (doc_id % (1 << 64)) + 1
    out = []
    for _ in range(digits):
        out.append(n % end)
        n //= end
    return out


def write_token_files(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN, end: int = END,
                      digits: int = DIGITS, docs_per_file: int = DOCS_PER_FILE, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenize every text and write flat files of two-byte ids to ``path``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            rows = []
            for i, t in zip(b.column("id").to_pylist(), byte_texts(b.column("text"))):
                tokens = encoding.encode_to_numpy(t.decode("utf-8", "replace"), disallowed_special=())
                rows.append(np.concatenate([header(i, end, digits), tokens]).astype("<u2").tobytes())
            yield pa.record_batch({"tokens": pa.array(rows, pa.binary())})

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # the text sink writes the bytes of each row and then the separator, here the closing id
    (bounded_batches(slim).mapInArrow(encode, "tokens binary").select(F.col("tokens").cast("string").alias("value"))
     .write.option("encoding", "ISO-8859-1").option("lineSep", np.uint16(end).astype("<u2").tobytes().decode("latin-1"))
     .option("maxRecordsPerFile", docs_per_file).text(path))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content): one row for each token file below ``path``."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def scan_blocks(files: DataFrame, end: int, width: int, head: int, block_tokens: int) -> DataFrame:
    """One row for each block: its length, what its first ``head`` tokens are, its first and last
    separator, the documents that begin and end in it, and how the last one begins."""
    kind = np.dtype("<u2" if width == 2 else "<u4")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content")):
                data = content.as_buffer()
                tokens = np.frombuffer(data, kind, len(data) // width)
                for no, at in enumerate(range(0, len(tokens), block_tokens)):
                    block = tokens[at: at + block_tokens]
                    ends = np.flatnonzero(block == end)
                    start, n = ends[:-1] + 1, np.diff(ends) - 1
                    begin = int(ends[-1]) + 1 if len(ends) else None
                    yield pa.RecordBatch.from_pylist([{
                        "path": path, "block": no, "n": len(block), "head": block[:head].tobytes(),
                        "first": int(ends[0]) if len(ends) else None, "last": int(ends[-1]) if len(ends) else None,
                        "tail": block[begin: begin + head].tobytes() if len(ends) else None,
                        "inner": [{"start": int(s), "n": int(k), "head": block[s: s + min(head, k)].tobytes()} for s, k in zip(start, n)],
                    }], schema)

    inner = pa.struct([("start", pa.int64()), ("n", pa.int64()), ("head", pa.binary())])
    schema = pa.schema([("path", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("head", pa.binary()), ("first", pa.int64()),
                        ("last", pa.int64()), ("tail", pa.binary()), ("inner", pa.list_(inner))])
    return files.mapInArrow(scan, "path string, block long, n long, head binary, first long, last long, tail binary, "
                                  "inner array<struct<start:bigint,n:bigint,head:binary>>")


def separator_scan(files: DataFrame, end: int, width: int = 2, head: int = 0, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(path, start, n_tokens, head, ended) of every document in files (path, content): ``start``
    counts tokens from the file's beginning, ``n_tokens`` leaves the separator out, ``head`` holds the
    bytes of its first ``head`` tokens.  Blocks hold at least ``head`` tokens."""
    if block_tokens < max(head, 1):
        raise ValueError("a block must hold the head of a document")
    blocks = scan_blocks(files, end, width, head, block_tokens)
    order = Window.partitionBy("path").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    # how a document begins that is open at the end of a block: its own tail and what the next block adds
    stitched = F.concat("tail", F.substring(F.coalesce(F.lead("head").over(order), F.lit(b"")), 1, head * width))
    stitched = F.substring(stitched, 1, head * width)
    at = F.coalesce(F.sum("n").over(before), F.lit(0))
    scanned = (blocks.withColumns({"at": at, "begun": stitched, "next_n": F.lead("n").over(order)})
               .withColumns({"last_end": F.col("at") + F.col("last")})
               .withColumns({"open_at": F.coalesce(F.last("last_end", True).over(before) + 1, F.lit(0)),
                             "open_head": F.last("begun", True).over(before),
                             "left_at": F.coalesce(F.last("last_end", True).over(upto) + 1, F.lit(0)),
                             "left_head": F.last("begun", True).over(upto),
                             "file_head": F.first("head").over(upto)}))

    def document(start: Column, stop: Column, first: Column, ended: bool) -> Column:
        n = stop - start
        cut = F.substring(F.coalesce(first, F.col("file_head")), F.lit(1), F.least(n, F.lit(head)).cast("int") * width)
        return F.struct(start.alias("start"), n.alias("n"), cut.alias("head"), F.lit(ended).alias("ended"))

    first = F.when(F.col("first").isNotNull(), F.array(document(F.col("open_at"), F.col("at") + F.col("first"), F.col("open_head"), True)))
    inside = F.transform("inner", lambda d: F.struct((d["start"] + F.col("at")).alias("start"), d["n"].alias("n"),
                                                     d["head"].alias("head"), F.lit(True).alias("ended")))
    end_of_file = F.col("at") + F.col("n")
    rest = F.when(F.col("next_n").isNull() & (F.col("left_at") < end_of_file),
                  F.array(document(F.col("left_at"), end_of_file, F.col("left_head"), False)))
    none = F.array().cast("array<struct<start:bigint,n:bigint,head:binary,ended:boolean>>")
    docs = F.concat(F.coalesce(first, none), inside, F.coalesce(rest, none))
    return (scanned.select("path", F.explode(docs).alias("d"))
            .select("path", "d.start", F.col("d.n").alias("n_tokens"), "d.head", "d.ended"))


def spelled_id(head: Column, end: int, digits: int) -> Column:
    """The id that a header of two-byte digits spells."""
    n = F.lit(0).cast("decimal(38,0)")
    for i in reversed(range(digits)):
        digit = F.conv(F.hex(F.concat(F.substring(head, 2 * i + 2, 1), F.substring(head, 2 * i + 1, 1))), 16, 10)
        n = (n * F.lit(end).cast("decimal(6,0)") + digit.cast("decimal(6,0)")).cast("decimal(38,0)")
    n = n - F.lit(1).cast("decimal(38,0)")
    top = F.lit(str(1 << 63)).cast("decimal(38,0)")
    return F.when(n >= 0, F.when(n < top, n).otherwise(n - F.lit(str(1 << 64)).cast("decimal(38,0)")).cast("long"))


def token_counts(docs: DataFrame, path: str | None = None, vocabulary: str = VOCABULARY, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, path, start) of every row of ``docs``, by way of flat files in ``path`` (a
    folder of the shared one, if None)."""
    path = path or f"{ensure_checkpoint_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, vocabulary, id_col=id_col, text_col=text_col)
    found = separator_scan(read_token_files(docs.sparkSession, path), END, 2, DIGITS)
    return found.select(spelled_id(F.col("head"), END, DIGITS).alias("doc_id"), (F.col("n_tokens") - DIGITS).alias("n_tokens"), "path", "start")

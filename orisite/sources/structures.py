"""Structure files -> ordered lines -> typed records.

A structure file is one *entry*; line order matters (first-error-wins checks and residue
numbering run in file order), so every line gets its exact place in the file, ``line_no`` = 0, 1, 2 ...
Small files, nearly all of them, are read whole, one row each, and unfolded with their positions.
Files above ``WHOLE_BYTES`` are read by many tasks each, a split at a time; a line's number is its
place in the split plus the lines of the splits before, a prefix sum over one row for each split.
Which file goes which way is told from the listing, so no file is read twice for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orisite.functions.fixed import char, field, float_field, int_field
from orisite.session import ensure_checkpoint_dir, settled

# Accepted structure-file suffixes (last three characters of the name).
STRUCTURE_SUFFIXES = ("pdb", "ent", "brk")
# Record names (columns 0:6) that matter.
ATOM = "ATOM  "
DBREF = ("DBREF ", "DBREF1")
MODEL = "MODEL "

RECORD_COLUMNS = ["entry", "line_no", "record", "altloc", "atomname", "resname", "chainid",
                  "resseq", "icode", "x", "y", "z", "malformed_at"]


#: Files up to this size are read whole, by one task.
WHOLE_BYTES = 32 << 20
#: Bytes that a byte of a compressed file is taken for.
GZIP_RATIO = 16
#: Rows of split offsets that are broadcast at most (some 50 MB of paths).
BROADCAST_SPLITS = 300_000
_SPLIT = ["file_path", "_start", "_part"]


def whole_lines(files: DataFrame) -> DataFrame:
    """Lines of files read whole (``value``); a line break at the end begins no further line."""
    text = F.regexp_replace("value", r"\r?\n\z", "")
    return files.select("entry", "file_path", F.posexplode(F.split(text, "\r?\n")).alias("line_no", "line")).select(
        "entry", "file_path", F.col("line_no").cast("long"), "line")


def split_offsets(lines: DataFrame) -> DataFrame:
    """For each split its first row id, its number of lines and the lines of its file before it."""
    splits = lines.groupBy(*_SPLIT).agg(F.min("_id").alias("_first"), F.count("*").alias("_lines"))
    before = Window.partitionBy("file_path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    return splits.withColumn("_before", F.coalesce(F.sum("_lines").over(before), F.lit(0)))


def number_split_lines(lines: DataFrame, offsets: DataFrame, broadcast: bool) -> DataFrame:
    """``line_no`` of lines that know their split and their row id in the read.

    The offsets come from a read of their own.  Both cut the files alike as long as the settings stay
    the same; a line whose split or place is not the one counted stops the run instead of getting
    a wrong number."""
    known = F.broadcast(offsets) if broadcast else offsets
    place = F.col("_id") - F.col("_first")
    same = place.isNotNull() & (place >= 0) & (place < F.col("_lines"))
    number = F.when(same, F.col("_before") + place).otherwise(
        F.raise_error(F.lit("files were cut into other splits than when their lines were counted")).cast("long"))
    return lines.join(known, _SPLIT, "left").select("entry", "file_path", number.alias("line_no"), "line")


def read_structure_lines(spark: SparkSession, path: str, whole_bytes: int = WHOLE_BYTES,
                         broadcast_splits: int = BROADCAST_SPLITS, compressed: bool = False) -> DataFrame:
    """S1.  ``(entry, file_path, line_no, line)`` for every structure file under ``path``
    (recursive).  ``entry`` is the base name; ``file_path`` lets QC spot two files with the
    same base name.  Lines end at ``\\n`` or ``\\r\\n``; the last one may lack its end.  ``compressed``: files
    whose suffix is followed by ``.gz`` too, as archives of structures have them."""
    glob = "*{" + ",".join(STRUCTURE_SUFFIXES + (tuple(f"{s}.gz" for s in STRUCTURE_SUFFIXES) if compressed else ())) + "}"
    # how files are packed into tasks must not change with the executors at hand between two reads
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", spark.sparkContext.defaultParallelism)

    def read(**how) -> DataFrame:
        return spark.read.options(recursiveFileLookup="true", pathGlobFilter=glob).text(path, **how)

    name = [F.col("_metadata.file_name").alias("entry"), F.col("_metadata.file_path").alias("file_path")]
    size = F.col("_metadata.file_size")
    if compressed:
        size = F.when(F.col("_metadata.file_name").endswith(".gz"), size * GZIP_RATIO).otherwise(size)
    small = whole_lines(read(wholetext=True).where(size <= whole_bytes).select(*name, "value"))
    # the filter is on the listing: files on its other side are not opened
    by_line = read(lineSep="\n").where(size > whole_bytes)
    lines = by_line.select(*name, F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"),
                           F.regexp_replace("value", r"\r\z", "").alias("line")).withColumn("_part", F.spark_partition_id())
    if not by_line.rdd.getNumPartitions():  # no large file
        return small
    offsets = split_offsets(lines)
    ensure_checkpoint_dir(spark)
    offsets = offsets.checkpoint()
    return small.unionByName(number_split_lines(lines, offsets, offsets.count() <= broadcast_splits))


def scan_records(lines: DataFrame) -> DataFrame:
    """S2 + P1.  Keep the records QC needs (ATOM, DBREF/DBREF1, MODEL), parse ATOM fields.

    ``malformed_at`` (our extension; the original stops the whole run) is 0 when the ATOM
    line is too short or its residue number unreadable (that parse happens before any check
    of the line), 5 when a coordinate is unreadable (parsed after the residue and atom
    checks), else NULL.  Every other record kind is dropped here, before any shuffle.
    """
    rec = field("line", 0, 6)
    # Parse every field exactly once (one projection), then derive flags from the parsed
    # columns; the numbers are settled, or a filter on the flags would parse them again.
    path = [k for k in ("file_path",) if k in lines.columns]
    parsed = lines.filter(rec.isin(ATOM, MODEL, *DBREF)).select(
        "entry", "line_no", *path, rec.alias("record"), F.length("line").alias("_len"),
        char("line", 16).alias("_altloc"), field("line", 12, 16).alias("_atomname"),
        field("line", 17, 20).alias("_resname"), char("line", 21).alias("_chainid"),
        int_field("line", 22, 26).alias("_resseq"), char("line", 26).alias("_icode"),
        float_field("line", 30, 38).alias("_x"), float_field("line", 38, 46).alias("_y"),
        float_field("line", 46, 54).alias("_z"))
    parsed = settled(parsed, ["_resseq", "_x", "_y", "_z"])
    c = F.col
    is_atom = c("record") == ATOM
    blank = c("_altloc") == " "
    early_bad = (c("_len") <= 16) | (blank & ((c("_len") <= 26) | c("_resseq").isNull()))
    late_bad = blank & (c("_x").isNull() | c("_y").isNull() | c("_z").isNull())
    return parsed.select(
        "entry", "line_no", *path, "record",
        *(F.when(is_atom, c(f"_{n}")).alias(n) for n in
          ("altloc", "atomname", "resname", "chainid", "resseq", "icode", "x", "y", "z")),
        F.when(is_atom & early_bad, F.lit(0)).when(is_atom & late_bad, F.lit(5)).alias("malformed_at"),
    )


def blank_altloc(records: DataFrame) -> DataFrame:
    """P2.  ATOM records without an alternate location, i.e. the atoms that count."""
    return records.filter((F.col("record") == ATOM) & (F.col("altloc") == " "))


def scan_atoms(lines: DataFrame) -> DataFrame:
    """S2 + P1 + P2 as one call: typed, blank-altloc, well-formed ATOM rows."""
    return blank_altloc(scan_records(lines)).filter(F.col("malformed_at").isNull()).select(
        "entry", "line_no", "altloc", "atomname", "resname", "chainid", "resseq", "icode", "x", "y", "z")

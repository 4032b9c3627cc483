"""Residue numbering along each entry, and chain ends.

The residue counter starts at 0 on an entry's first atom and then grows, atom by atom, by
  * the resseq difference when the chain is the same and resseq grows,
  * 1 when the chain and resseq are the same but the insertion code changes,
  * 1 when the chain changes (chains are never reset; returning to a chain is +1),
  * 0 otherwise.
It is a running sum of a lag-based delta.  An entry of at most ``block_lines`` atoms, as nearly all
are, is one window.  Longer entries are scanned in levels, whatever their line numbers: their atoms are
sorted in ranges of (entry, line_no) and numbered 0, 1, 2 ... by the sizes of the ranges before; blocks
of exactly ``block_lines`` atoms are scanned by themselves; the block summaries are scanned the same
way, in groups of ``GROUP_BLOCKS``, group summaries again, until one group is left, and each level hands
the last atom and the offset down to the next.  No task holds more than one block or one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orisite.session import ensure_checkpoint_dir, lies_whole

DEFAULT_BLOCK_LINES = 1 << 16
#: Block summaries, or group summaries, that are scanned as one.
GROUP_BLOCKS = 1 << 12
#: Long entries, or their stretches, that are broadcast at most (some 50 MB of names).
BROADCAST_ENTRIES = 500_000
# What is compared with the previous atom; chain and insertion code as whole strings.
_KEY = ("chainid", "resseq", "icode")


def _delta(prev: list[Column], cur: list[Column]) -> Column:
    """Counter increase from the previous atom ``prev`` to ``cur`` (lists of _KEY columns)."""
    (pc, pr, pi), (cc, cr, ci) = prev, cur
    return (F.when(pc.isNull(), F.lit(0))
            .when(cc != pc, F.lit(1))
            .when(cr > pr, cr - pr)
            .when((cr == pr) & (ci != pi), F.lit(1))
            .otherwise(F.lit(0)))


def _lagged(rows: DataFrame, by: list[str], order: str, inner: Column | None = None) -> DataFrame:
    """Inside each group of ``by``: ``_p*``, the previous row's key, ``_d``, the increase from it, and
    ``_run``, the running sum of the increases (and of what the previous rows hold inside them)."""
    w = Window.partitionBy(*by).orderBy(order)
    cur = [F.col(f"_f{k}" if inner is not None else k) for k in _KEY]
    last = [f"_l{k}" if inner is not None else k for k in _KEY]
    rows = rows.withColumns({f"_p{k}": F.lag(c).over(w) for k, c in zip(_KEY, last)})
    rows = rows.withColumn("_d", _delta([F.col(f"_p{k}") for k in _KEY], cur))
    run = F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    if inner is not None:
        run = run + F.coalesce(F.sum(inner).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_run", run)


def _carried(blocks: DataFrame, most: int, group: int) -> DataFrame:
    """(entry, _blk, _base, _q*) from block summaries (entry, _blk, _f*, _l*, _inner), whose numbers
    are dense and at most ``most`` for each entry: the counter at a block's first atom, and the atom before it."""
    if most <= group:
        done = _lagged(blocks, ["entry"], "_blk", F.col("_inner"))
        return done.select("entry", "_blk", F.col("_run").alias("_base"), *(F.col(f"_p{k}").alias(f"_q{k}") for k in _KEY))
    done = _lagged(blocks.withColumn("_grp", F.expr(f"_blk div {group}")), ["entry", "_grp"], "_blk", F.col("_inner"))
    groups = done.groupBy("entry", "_grp").agg(
        *(F.min_by(f"_f{k}", "_blk").alias(f"_f{k}") for k in _KEY), *(F.max_by(f"_l{k}", "_blk").alias(f"_l{k}") for k in _KEY),
        F.sum(F.col("_d") + F.col("_inner")).alias("_inner"))
    above = _carried(groups.withColumnRenamed("_grp", "_blk"), -(-most // group), group)
    return done.join(above.withColumnsRenamed({"_blk": "_grp"}), ["entry", "_grp"]).select(
        "entry", "_blk", (F.col("_base") + F.col("_run")).alias("_base"),
        *(F.coalesce(f"_p{k}", f"_q{k}").alias(f"_q{k}") for k in _KEY))


def blocked(atoms: DataFrame, block_lines: int, materialize=None) -> DataFrame:
    """``atoms`` with ``_ord``, the dense number of an atom in its entry by line number, and ``_blk``, that
    of its block of ``block_lines``.  The sorted atoms are written, since their places in the ranges
    must not be computed twice."""
    ranged = (atoms.repartitionByRange("entry", "line_no").sortWithinPartitions("entry", "line_no")
              .withColumn("_pid", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()))
    if materialize is not None:
        ranged = materialize(ranged, "numbering_ranges")
    else:
        ensure_checkpoint_dir(atoms.sparkSession)
        ranged = ranged.checkpoint()
    runs = ranged.groupBy("entry", "_pid").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("entry").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("entry", "_pid", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    few = runs.limit(BROADCAST_ENTRIES + 1).count() <= BROADCAST_ENTRIES
    out = ranged.join(F.broadcast(runs) if few else runs, ["entry", "_pid"])
    out = out.withColumn("_ord", F.col("_before") + F.col("_id") - F.col("_first"))
    return out.withColumn("_blk", F.expr(f"_ord div {int(block_lines)}")).drop("_pid", "_id", "_first", "_before")


def _scan_blocks(atoms: DataFrame, most: int, block_lines: int, group: int, materialize) -> DataFrame:
    c = F.col
    a = _lagged(blocked(atoms, block_lines, materialize), ["entry", "_blk"], "_ord")
    if materialize is not None:
        a = materialize(a, "numbering_blocks", ["entry", "_blk"])
    blocks = a.groupBy("entry", "_blk").agg(
        *(F.min_by(k, "_ord").alias(f"_f{k}") for k in _KEY), *(F.max_by(k, "_ord").alias(f"_l{k}") for k in _KEY),
        F.sum("_d").alias("_inner"))
    out = a.join(_carried(blocks, -(-most // block_lines), group), ["entry", "_blk"])
    # the atom before the first of a block is the last one of the block before
    prev = {k: F.coalesce(c(f"_p{k}"), c(f"_q{k}")) for k in ("chainid", "resseq")}
    return _finished(out, c("_base") + c("_run"), prev).drop("_base", "_ord", "_blk", *(f"_q{k}" for k in _KEY))


def _finished(rows: DataFrame, counter: Column, prev: dict[str, Column]) -> DataFrame:
    fell = (prev["chainid"] == F.col("chainid")) & (F.col("resseq") < prev["resseq"])
    return rows.withColumns({"rescounter": counter.cast("int"), "out_of_order": F.coalesce(fell, F.lit(False))}).drop(
        "_d", "_run", *(f"_p{k}" for k in _KEY))


def entry_sizes(counted: DataFrame, block_lines: int) -> tuple[int, int | None, DataFrame]:
    """How many entries have over ``block_lines`` rows, the most rows of one, and their names."""
    sizes = counted.groupBy("entry").agg(F.count("*").alias("_n")).where(F.col("_n") > block_lines)
    n_long, most = sizes.agg(F.count("*"), F.max("_n")).first()
    return n_long, most, sizes.select("entry")


def scan_in_place(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rescounter`` and ``out_of_order`` by one window for each group of ``by``: an entry, or its atoms and the
    rest of its rows apart."""
    return _finished(_lagged(rows, by, "line_no"), F.col("_run"), {k: F.col(f"_p{k}") for k in _KEY})


def scan_residues(atoms: DataFrame, block_lines: int = DEFAULT_BLOCK_LINES, materialize=None, counted: DataFrame | None = None,
                  group_blocks: int = GROUP_BLOCKS) -> DataFrame:
    """Adds ``rescounter`` (int) and ``out_of_order`` (resseq fell inside one chain run), and
    returns the rows partitioned on the residue key; rows that come in whole entries (``lies_whole``) stay
    where they are if no entry is long, which serves whatever groups by the residue key as well.

    ``atoms`` needs ``entry, line_no, chainid, resseq, icode``; ``line_no`` orders an entry.
    The atoms of each entry are counted first, to tell the long entries; ``counted`` may name rows
    that are cheaper to count and include them.  ``materialize`` (optional) writes the intermediate tables
    of the long entries once.
    """
    n_long, most, names = entry_sizes(atoms if counted is None else counted, block_lines)
    short, parts = atoms, []
    if n_long:
        names = F.broadcast(names) if n_long <= BROADCAST_ENTRIES else names
        parts.append(_scan_blocks(atoms.join(names, "entry", "left_semi"), most, block_lines, group_blocks, materialize))
        short = atoms.join(names, "entry", "left_anti")
    out = scan_in_place(short, ["entry"])
    if not parts and lies_whole(atoms, "entry"):
        return out
    for p in parts:
        out = out.unionByName(p)
    # Everything after numbering works per residue: partition once on the residue key
    # (fine grained, so no hot partition even when one entry is huge).
    buckets = getattr(materialize, "buckets", None)
    return out.repartition(*([buckets] if buckets else []), "entry", "chainid", "rescounter")


def number_residues(atoms: DataFrame, block_lines: int = DEFAULT_BLOCK_LINES, materialize=None) -> DataFrame:
    """W1.  The atom table with ``rescounter``; helper columns dropped."""
    return scan_residues(atoms, block_lines, materialize).drop("out_of_order")


def chain_ends(atoms: DataFrame) -> DataFrame:
    """W2 / A2.  Last residue of every ``(entry, chainid)``: a grouped max (partial
    aggregation first, so one huge chain costs one row per task)."""
    return atoms.groupBy("entry", "chainid").agg(F.max("rescounter").alias("rescounter"))


def mark_chain_ends(atoms: DataFrame) -> DataFrame:
    """Adds ``is_end``: the atom's residue is the last one of its chain.  Atoms that come in whole entries
    are marked where they are, by a window; others by a join with ``chain_ends``."""
    if lies_whole(atoms, "entry"):
        last = F.max("rescounter").over(Window.partitionBy("entry", "chainid"))
        found = F.col("entry").isNotNull() & F.col("chainid").isNotNull() & (F.col("rescounter") == last)
        key = ["entry", "chainid", "rescounter"]
        return atoms.select(*key, *(c for c in atoms.columns if c not in key), F.coalesce(found, F.lit(False)).alias("is_end"))
    ends = chain_ends(atoms).withColumn("is_end", F.lit(True))
    return (atoms.join(ends, ["entry", "chainid", "rescounter"], "left")
                 .withColumn("is_end", F.coalesce("is_end", F.lit(False))))

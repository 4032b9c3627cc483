"""Q1-Q7: quality control of structure entries as set operators over all files at once.

An entry (file) is excluded whole, with one reason: the error met first when reading the
file top to bottom.  Instead of stopping at that line, every line that *would* fail is
tagged with ``(line_no, check_order)`` and the smallest tag per entry wins
(``min_by``).  Before the first failing line all kept atoms are valid, so checks that look
at the previous atom can use all atoms.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from orisite.operators.numbering import DEFAULT_BLOCK_LINES, entry_sizes, scan_in_place, scan_residues
from orisite.session import lies_whole
from orisite.sources.structures import ATOM, DBREF, MODEL, blank_altloc
from orisite.sources.topology import Topology

# Exclusion reasons, as written to the error table.
ENSEMBLE = "Ensemble of models"
NO_DBREF = "No DBREF entry found"
OUT_OF_ORDER = "Residue indices out of order"
UNKNOWN_RESIDUE = "Residue not among the known amino acids"
UNKNOWN_ATOM = "Unknown atom"
# Our extensions (the original stops the whole run in these cases).
MALFORMED = "Malformed ATOM record"
DUPLICATE_ATOM = "Duplicate atom"
DUPLICATE_ENTRY = "Duplicate entry"

RESIDUE_KEY = ["entry", "chainid", "rescounter"]
#: Rejected entries that are broadcast at most (some 50 MB of names).
BROADCAST_ENTRIES = 500_000
ATOM_COLUMNS = ["entry", "chainid", "resseq", "icode", "rescounter", "resname", "atomname", "x", "y", "z"]


class Checked(NamedTuple):
    numbered: DataFrame  # every blank-altloc atom with rescounter, partitioned by residue key
    candidates: DataFrame  # entry, line_no, check_order, reason
    errors: DataFrame  # entry, reason
    clean: DataFrame  # atom table of the entries that pass


def known_atoms(atoms: DataFrame, topology: Topology) -> DataFrame:
    """Q4 + Q5 membership tests as two broadcast left joins: adds ``res_known``, ``atom_known``.
    Both right sides are topology tables (size fixed by the chemistry)."""
    res = F.broadcast(topology.residue_types().withColumn("res_known", F.lit(True)))
    known = F.broadcast(topology.atoms.select("resname", "atomname").distinct().withColumn("atom_known", F.lit(True)))
    return (atoms.join(res, "resname", "left").join(known, ["resname", "atomname"], "left")
                 .withColumn("res_known", F.coalesce("res_known", F.lit(False)))
                 .withColumn("atom_known", F.coalesce("atom_known", F.lit(False))))


def record_candidates(records: DataFrame) -> DataFrame:
    """Q1, Q2 and our record-level extensions, in one pass: one summary row for each entry, from
    which the candidates are unfolded.  A missing DBREF sits on the first blank-altloc atom; a
    name found in two folders (only if ``records`` has ``file_path``) before all lines."""
    c = F.col
    is_atom = (c("record") == ATOM) & (c("altloc") == " ")
    paths = [F.min("file_path").alias("_p0"), F.max("file_path").alias("_p1")] if "file_path" in records.columns else []
    e = records.groupBy("entry").agg(
        F.min(F.when(c("record") == MODEL, c("line_no"))).alias("_model"),
        F.min(F.when(c("malformed_at") == 0, c("line_no"))).alias("_bad"),
        F.min(F.when(is_atom, c("line_no"))).alias("_atom"),
        F.min(F.when(c("record").isin(*DBREF), c("line_no"))).alias("_dbref"), *paths)
    no_dbref = F.when(c("_dbref").isNull() | (c("_dbref") > c("_atom")), c("_atom"))
    found = [(c("_model"), 0, ENSEMBLE), (c("_bad"), 0, MALFORMED), (no_dbref, 1, NO_DBREF)]
    if paths:
        found.append((F.when(c("_p0") != c("_p1"), F.lit(-1).cast("long")), -1, DUPLICATE_ENTRY))
    return e.select("entry", F.inline(F.array(*(
        F.struct(at.alias("line_no"), F.lit(o).alias("check_order"), F.lit(r).alias("reason")) for at, o, r in found)))
    ).filter(c("line_no").isNotNull())


def repeated_atoms(numbered: DataFrame) -> DataFrame:
    """The atom keys ``(entry, chainid, rescounter, atomname)`` that occur more than once: a hash
    aggregate on the partitioning that ``numbered`` already has."""
    return numbered.groupBy(*RESIDUE_KEY, "atomname").agg(F.count("*").alias("_n")).where(F.col("_n") > 1).drop("_n")


def duplicate_atoms(numbered: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """Q7.  Every repeat of an atom key after its first occurrence; ``occurrence`` counts from 2.
    Only the atoms of repeated keys (given, or found) are ordered."""
    keys = repeated_atoms(numbered) if repeated is None else repeated
    w = Window.partitionBy(*RESIDUE_KEY, "atomname").orderBy("line_no")
    some = numbered.select(*RESIDUE_KEY, "atomname", "line_no").join(keys, RESIDUE_KEY + ["atomname"], "left_semi")
    return some.withColumn("occurrence", F.row_number().over(w)).filter(F.col("occurrence") > 1)


def drop_entries(numbered: DataFrame, errors: DataFrame, materialize=None,
                 broadcast_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """Q6.  The rows of ``numbered`` whose entry is not in ``errors``.

    With written inputs the atoms are not shuffled: up to ``broadcast_entries`` rejected entries are
    broadcast; beyond, the *residues* of rejected entries are found (one short row for each) and
    written bucketed like ``numbered``, so the atoms are filtered in place.
    """
    bad = errors.select("entry")
    if materialize is None:
        return numbered.join(bad, "entry", "left_anti")
    if errors.count() <= broadcast_entries:
        return numbered.join(F.broadcast(bad), "entry", "left_anti")
    rejected = numbered.select(*RESIDUE_KEY).distinct().join(bad, "entry", "left_semi")
    rejected = materialize(rejected.repartition(*RESIDUE_KEY), "rejected", RESIDUE_KEY)
    return numbered.join(rejected, RESIDUE_KEY, "left_anti")


def check_entries(records: DataFrame, topology: Topology, block_lines: int = DEFAULT_BLOCK_LINES,
                  materialize=None, broadcast_entries: int = BROADCAST_ENTRIES, counted: DataFrame | None = None) -> Checked:
    """Q1-Q7 + W1 over ``scan_records`` output.

    Checks of one atom come from one projection over one flagged atom table (the first
    failing check of each line, as one CASE), so the numbering runs once; repeated atoms are found by
    an aggregate over it; record-level checks (MODEL, unreadable record, missing DBREF, repeated name)
    come from one summary of each entry's records.  Shuffles: one on ``entry`` for numbering, one on the
    residue key that every later operator reuses; the error table is one row per rejected entry.
    ``materialize`` (see ``session.Materializer``) writes the flagged atoms once when both the errors
    and the clean atoms are needed.  Records that come in whole entries, none of them long, are numbered and
    written in one pass without a shuffle, the few that are no atoms too, and the summary reads them there.
    ``counted`` may name rows that are cheaper to count by entry than ``records`` and include them.
    """
    topology.require_keys()
    counted = records.select("entry") if counted is None else counted
    is_kept = (F.col("record") == ATOM) & (F.col("altloc") == " ") & (F.col("malformed_at").isNull() | (F.col("malformed_at") > 0))
    repeated = None
    if materialize is not None and lies_whole(records, "entry") and not entry_sizes(counted, block_lines)[0]:
        every = scan_in_place(records.withColumn("kept", F.coalesce(is_kept, F.lit(False))), ["entry", "kept"])
        records = materialize(every, "records", ["entry"])
        flagged = known_atoms(records.filter("kept").drop("kept"), topology)
        repeated = repeated_atoms(flagged)
        in_place = True
    else:
        flagged = known_atoms(scan_residues(records.filter(is_kept), block_lines, materialize, counted=counted), topology)
        in_place = False
    if materialize is not None and not in_place:
        flagged = materialize(flagged, "numbered", RESIDUE_KEY)
        repeated = materialize(repeated_atoms(flagged), "repeated")
        if repeated.limit(BROADCAST_ENTRIES + 1).count() <= BROADCAST_ENTRIES:
            repeated = F.broadcast(repeated)
    c = F.col
    checks = [(c("out_of_order"), 2, OUT_OF_ORDER), (~c("res_known"), 3, UNKNOWN_RESIDUE),
              (~c("atom_known"), 4, UNKNOWN_ATOM), (c("malformed_at") == 5, 5, MALFORMED)]
    order, reason = F, F
    for cond, o, r in checks:
        order, reason = order.when(cond, F.lit(o)), reason.when(cond, F.lit(r))
    atom_cands = flagged.select("entry", "line_no", order.alias("check_order"), reason.alias("reason")).filter(
        c("check_order").isNotNull())
    duplicates = duplicate_atoms(flagged, repeated).select(
        "entry", "line_no", F.lit(6).alias("check_order"), F.lit(DUPLICATE_ATOM).alias("reason"))
    candidates = atom_cands.unionByName(duplicates).unionByName(record_candidates(records))
    errors = entry_errors_from(candidates)
    if materialize is not None:
        errors = materialize(errors, "errors")  # one row per rejected entry; read twice
    clean = drop_entries(flagged, errors, materialize, broadcast_entries).select(*ATOM_COLUMNS)
    return Checked(flagged, candidates, errors, clean)


# Position of each reason among the checks of one line (the order the checks run in).
_REASON_CODE = [(ENSEMBLE, 0, 0), (MALFORMED, 0, 1), (NO_DBREF, 1, 2), (OUT_OF_ORDER, 2, 3),
                (UNKNOWN_RESIDUE, 3, 4), (UNKNOWN_ATOM, 4, 5), (MALFORMED, 5, 6), (DUPLICATE_ATOM, 6, 7),
                (DUPLICATE_ENTRY, -1, 8)]


def entry_errors_from(candidates: DataFrame) -> DataFrame:
    """Q6.  First error per entry: smallest ``(line_no, check_order)``.  Both go into one long
    (``line_no * 16 + code``) so the pick is a plain hash-aggregated ``min``."""
    code = F
    for reason, order, k in _REASON_CODE:
        code = code.when((F.col("reason") == reason) & (F.col("check_order") == order), F.lit(k))
    g = candidates.select("entry", (F.col("line_no") * 16 + code).alias("_k")).groupBy("entry").agg(
        F.min("_k").alias("_k"))
    back = F
    for reason, _, k in _REASON_CODE:
        back = back.when(F.pmod(F.col("_k"), F.lit(16)) == k, F.lit(reason))
    return g.select("entry", back.alias("reason"))


def entry_errors(records: DataFrame, topology: Topology, block_lines: int = DEFAULT_BLOCK_LINES) -> DataFrame:
    """``pdb_file_error_table``: ``(entry, reason)``."""
    return check_entries(records, topology, block_lines).errors


def clean_atoms(records: DataFrame, topology: Topology, block_lines: int = DEFAULT_BLOCK_LINES) -> DataFrame:
    """``pdb`` without siteid: the numbered atoms of every entry that passes QC."""
    return check_entries(records, topology, block_lines).clean

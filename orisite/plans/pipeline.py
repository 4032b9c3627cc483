"""The whole round trip, stage by stage.

lines -> records -> QC + numbering (clean atoms) -> chain ends + site ids (pdb) -> sites (cg)
-> local frames (relative) -> moments -> predictors -> pairs -> cov -> residuals -> rmsd

``Stages`` builds each table once.  With a ``Materializer`` every stage that is read more
than once is written to the shared checkpoint folder (bucketed on the residue key where it
is joined on it) and read back; without one the plan stays lazy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orisite.operators.corrections import apply_corrections, corrected_predictor, fit_corrections, \
    predict_correcting, regression_pairs
from orisite.operators.frames import frame_moments, to_site_frame
from orisite.operators.numbering import DEFAULT_BLOCK_LINES, mark_chain_ends
from orisite.operators.quality import Checked, check_entries
from orisite.operators.report import rmsd_report
from orisite.operators.sites import FRAME_COLUMNS, assign_sites, drop_degenerate_sites, orient_sites, site_positions
from orisite.session import Materializer, lies_whole, settled
from orisite.sources.sinks import publish
from orisite.sources.structures import scan_records
from orisite.sources.topology import Topology

RESIDUE_KEY = ["entry", "chainid", "rescounter"]
#: Stages with a row for each atom, or site.
ATOM_STAGES = ("atoms", "pdb", "cg", "relative")
Materialize = Callable[..., DataFrame]


def _lazy(df: DataFrame, name: str, bucket_by: list[str] | None = None) -> DataFrame:
    return df


class Stages:
    """Memoised stage tables of one analysis, from a clean numbered atom table.

    Atoms that come in whole entries (``lies_whole``) need no shuffle for anything here, so their stages of the
    atoms' size are not written but computed again by each reader; the pairs of the corrections and the small
    tables are written."""

    def __init__(self, atoms: DataFrame, topology: Topology, legacy_y: bool = False,
                 materialize: Materialize | None = None, atoms_are_cheap: bool = False):
        self.topology, self.legacy_y = topology.require_keys(), legacy_y
        self.m = materialize or _lazy
        self._atoms = atoms
        self._memo: dict[str, DataFrame] = {}
        self._whole = materialize is not None and lies_whole(atoms, "entry")
        if atoms_are_cheap:  # already a projection of a written, residue-bucketed table
            self._memo["atoms"] = atoms

    def _get(self, name: str, build: Callable[[], DataFrame], bucket: bool = True) -> DataFrame:
        if name not in self._memo:
            if not self._whole:
                self._memo[name] = self.m(build(), name, RESIDUE_KEY if bucket else None)
            else:
                self._memo[name] = build() if name in ATOM_STAGES else self.m(build(), name)
        return self._memo[name]

    @property
    def atoms(self) -> DataFrame:
        return self._get("atoms", lambda: self._atoms)

    @property
    def pdb(self) -> DataFrame:
        """Clean atoms + ``is_end`` + ``siteid``."""
        return self._get("pdb", lambda: assign_sites(mark_chain_ends(self.atoms), self.topology))

    @property
    def cg(self) -> DataFrame:
        return drop_degenerate_sites(self._get("cg", lambda: settled(
            orient_sites(site_positions(self.pdb, self.topology), drop_degenerate=False), FRAME_COLUMNS)))

    @property
    def relative(self) -> DataFrame:
        return self._get("relative", lambda: to_site_frame(self.pdb, self.cg))

    @property
    def moments(self) -> DataFrame:
        return self._get("moments", lambda: frame_moments(self.relative), bucket=False)

    @property
    def labframe(self) -> DataFrame:
        return predict_correcting(self.moments, self.cg, self.topology, self.legacy_y)

    @property
    def predictor(self) -> DataFrame:
        return corrected_predictor(self.labframe, self.cg, self.topology)

    @property
    def pairs(self) -> DataFrame:
        return self._get("pairs", lambda: regression_pairs(
            self.relative, self.moments, self.predictor, self.topology.corrected_atoms()))

    @property
    def cov(self) -> DataFrame:
        return self._get("cov", lambda: fit_corrections(self.pairs), bucket=False)

    @property
    def residuals(self) -> DataFrame:
        return apply_corrections(self.pairs, self.cov)

    @property
    def rmsd(self) -> DataFrame:
        return rmsd_report(self.moments, self.residuals, self.topology)


def check_lines(lines: DataFrame, topology: Topology, block_lines: int = DEFAULT_BLOCK_LINES,
                materialize: Materialize | None = None, counted: DataFrame | None = None) -> Checked:
    """S2 + Q1-Q7 + W1 from structure lines ``(entry, line_no, line)``.  Lines read from files
    also carry ``file_path``; then an entry name found in two folders is rejected too.  ``counted``: the entries
    of the lines, if there is a cheaper way to them."""
    return check_entries(scan_records(lines), topology, block_lines, materialize=materialize,
                         counted=lines.select("entry") if counted is None else counted)


def analyse_lines(spark: SparkSession, lines: DataFrame, topology: Topology, legacy_y: bool = False,
                  block_lines: int = DEFAULT_BLOCK_LINES, materialize: Materialize | None = None,
                  counted: DataFrame | None = None) -> tuple[DataFrame, Stages]:
    """Errors table and the stages of the clean entries."""
    checked = check_lines(lines, topology, block_lines, materialize, counted)
    return checked.errors, Stages(checked.clean, topology, legacy_y, materialize,
                                  atoms_are_cheap=materialize is not None)


def run(spark: SparkSession, lines: DataFrame, topology: Topology, out: str, legacy_y: bool = False,
        block_lines: int = DEFAULT_BLOCK_LINES, buckets: int | None = None) -> dict[str, str]:
    """Run everything and publish ``pdb_file_error_table``, ``pdb``, ``cg``, ``moments``,
    ``cov`` and ``rmsd`` under ``out`` (a shared folder) as one version; returns their paths, which
    ``sinks.result_paths`` finds again.  Intermediate stages go to the session's checkpoint folder in
    ``buckets`` buckets and are dropped at the end."""
    stages = Materializer(spark, buckets=buckets)
    try:
        errors, st = analyse_lines(spark, lines, topology, legacy_y, block_lines, stages)
        return publish(spark, out, {
            "pdb_file_error_table": errors,
            "pdb": st.pdb.drop("is_end"),
            "cg": st.cg,
            "moments": st.moments,
            "cov": st.cov,
            "rmsd": st.rmsd,
        })
    finally:
        stages.drop()

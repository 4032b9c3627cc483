"""Quality control and numbering: hand-made edge cases, one tiny entry each."""

import pytest

from helpers import C, CA, CB, N, O, OXT, atom, lines_df, topology
from orisite.operators.numbering import number_residues
from orisite.operators.quality import check_entries
from orisite.sources.structures import scan_atoms, scan_records

DB = "DBREF  1ABC"


def _residue(serial0, resseq, chain="A", resname="AAA", icode=" ", names=(N, CA, C, O, CB)):
    return [atom(serial0 + i, n, resname, chain, resseq, i * 1.1, i * 0.7, -i * 0.3, icode=icode)
            for i, n in enumerate(names)]


def _errors(spark, entries, **kw):
    chk = check_entries(scan_records(lines_df(spark, entries)), topology(spark), **kw)
    return dict((r.entry, r.reason) for r in chk.errors.collect()), chk


CASES = {
    "no_dbref": ([*_residue(1, 1), DB], "No DBREF entry found"),
    "model": ([DB, "MODEL        1", *_residue(1, 1)], "Ensemble of models"),
    "out_of_order": ([DB, *_residue(1, 5), *_residue(9, 4)], "Residue indices out of order"),
    "unknown_residue_first": ([DB, atom(1, " XX ", "QQQ", "A", 1, 0, 0, 0)], "Residue not among the known amino acids"),
    "unknown_atom": ([DB, *_residue(1, 1), atom(9, " XX ", "AAA", "A", 1, 0, 0, 0)], "Unknown atom"),
    "first_line_wins": ([DB, *_residue(1, 1), atom(9, " XX ", "AAA", "A", 1, 0, 0, 0), "MODEL        2"],
                        "Unknown atom"),
    "duplicate": ([DB, *_residue(1, 1), atom(9, CA, "AAA", "A", 1, 0, 0, 0)], "Duplicate atom"),
    "bad_number": ([DB, atom(1, N, "AAA", "A", 1, 0, 0, 0)[:30] + "  xx.xxx" + atom(1, N, "AAA", "A", 1, 0, 0, 0)[38:]],
                   "Malformed ATOM record"),
    "short_line": ([DB, "ATOM      1  N   AAA A"], "Malformed ATOM record"),
}


@pytest.mark.parametrize("name", list(CASES))
def test_exclusion_reason(spark, name):
    lines, reason = CASES[name]
    errs, _ = _errors(spark, {name: lines})
    assert errs == {name: reason}


def test_clean_entries_pass_and_ignored_records(spark):
    entries = {
        "chain_change": [DB, *_residue(1, 5, "A"), *_residue(9, 4, "B")],
        "altloc_unknown": [DB, *_residue(1, 1), atom(9, " XX ", "QQQ", "A", 1, 0, 0, 0, altloc="A")],
        "hetatm_only": [DB, atom(1, " FE ", "HEM", "A", 1, 0, 0, 0, record="HETATM")],
    }
    errs, chk = _errors(spark, entries)
    assert errs == {}
    got = {r.entry for r in chk.clean.collect()}
    assert got == {"chain_change", "altloc_unknown"}


def test_numbering_rules_and_block_independence(spark):
    lines = [DB, *_residue(1, 52, names=(N,)), *_residue(2, 52, icode="A", names=(N,)), *_residue(3, 53, names=(N,)),
             *_residue(4, 58, names=(N,)), *_residue(5, 3, chain="B", names=(N,)), *_residue(6, 58, names=(N,)),
             *_residue(7, 58, names=(CA,))]
    atoms = scan_atoms(lines_df(spark, {"e": lines}))
    expect = [0, 1, 2, 7, 8, 9, 9]
    for block in (1, 2, 3, 1 << 16):
        got = [r.rescounter for r in number_residues(atoms, block_lines=block).orderBy("line_no").collect()]
        assert got == expect, block


def test_out_of_order_found_across_block_border(spark):
    lines = [DB, *_residue(1, 5, names=(N,)), *_residue(2, 6, names=(N,)), *_residue(3, 4, names=(N,))]
    for block in (1, 2, 1 << 16):
        errs, _ = _errors(spark, {"e": lines}, block_lines=block)
        assert errs == {"e": "Residue indices out of order"}

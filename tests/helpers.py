"""Tiny hand-made structures and a topology of our own for unit tests."""

from __future__ import annotations

from orisite.sources.topology import Topology

N, CA, C, O, OXT, CB, CG, CD = " N  ", " CA ", " C  ", " O  ", " OXT", " CB ", " CG ", " CD "


def atom(serial, name, resname, chain, resseq, x, y, z, altloc=" ", icode=" ", record="ATOM  "):
    return (f"{record}{serial:5d} {name:4s}{altloc}{resname:3s} {chain}{resseq:4d}{icode}   "
            f"{x:8.3f}{y:8.3f}{z:8.3f}  1.00  0.00")


def topology(spark) -> Topology:
    aaa = [N, CA, C, O, OXT, CB]
    bbb = aaa + [CG, CD]
    atoms = [("AAA", a, i + 1) for i, a in enumerate(aaa)] + [("BBB", a, i + 1) for i, a in enumerate(bbb)]
    members = [(r, a, 1 if a in (CG, CD) else 0) for r, a, _ in atoms]
    return Topology.from_rows(
        spark, atoms=atoms, members=members,
        directors=[("AAA", 0, 0, CA, C, N), ("BBB", 0, 0, CA, C, N), ("BBB", 1, 0, CG, CD, CB)],
        terminus=[(C, O, OXT)], corrections=[("BBB", CB, CD)])


def lines_df(spark, entries: dict[str, list[str]]):
    rows = [(e, i, l) for e, ls in entries.items() for i, l in enumerate(ls)]
    return spark.createDataFrame(rows, "entry string, line_no long, line string")


# Residue geometry (Angstrom-ish) used to place atoms; rotated/shifted copies keep it.
GEOM = {N: (0.3, 0.9, 1.9), CA: (1.2, -0.4, 0.8), C: (2.1, 0.7, 0.3),
        O: (2.9, 1.2, 1.1), OXT: (2.2, 1.1, -0.9), CB: (0.9, -1.6, 1.5),
        CG: (0.1, -2.6, 0.8), CD: (-0.8, -3.3, 1.7)}

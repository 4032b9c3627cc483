"""Text sources from real files: structure folder scan, parameter parsers, bonds, and the
written result tables."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from helpers import C, CA, CB, CD, CG, N, O, OXT, atom
from orisite.plans.pipeline import run
from orisite.sources import topology as T
from orisite.sources.structures import read_structure_lines, scan_atoms


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_structure_scan_suffix_recursive_and_order(spark):
    d = tempfile.mkdtemp(prefix="orisite-src-")
    lines = ["DBREF  1ABC", atom(1, N, "AAA", "A", 1, 1, 2, 3), atom(2, CA, "AAA", "A", 1, 4, 5, 6)]
    _write(f"{d}/a/pdb1abc.ent", "\n".join(lines) + "\n")
    _write(f"{d}/b/c/x2pdb", "\n".join(lines[:2]) + "\n")  # suffix without a dot still counts
    _write(f"{d}/readme.txt", "ATOM nothing")
    got = read_structure_lines(spark, d)
    assert {r.entry for r in got.select("entry").distinct().collect()} == {"pdb1abc.ent", "x2pdb"}
    a = scan_atoms(got).filter("entry = 'pdb1abc.ent'").orderBy("line_no").collect()
    assert [r.atomname for r in a] == [N, CA] and a[1].x == 4.0 and a[0].line_no == 1


def _topology_files(root):
    _write(f"{root}/tmpl/AAA.pdb", "\n".join([
        atom(1, N, "AAA", "A", 0, 0, 0, 0), atom(2, CA, "AAA", "A", 0, 0, 0, 0), atom(3, C, "AAA", "A", 0, 0, 0, 0),
        "CONECT    1    2", "CONECT    2    1    3", "CONECT    3    2", "END"]) + "\n")
    _write(f"{root}/dirs.txt", "AAA10 CA  C   N  \nBBB20 CA  C   N  0 CG  CD  CB \n")
    _write(f"{root}/members.txt", "AAA N  0 CA 0 C  0\nBBB N  0 CA 0 CB 0 CG 1 CD 1xx\n")
    _write(f"{root}/term.txt", " C  \n O  \n OXT\n")
    _write(f"{root}/corr.txt", "BBB CB  CG \n")


def test_parameter_parsers(spark):
    d = tempfile.mkdtemp(prefix="orisite-top-")
    _topology_files(d)
    topo = T.read_topology(spark, f"{d}/tmpl", f"{d}/dirs.txt", f"{d}/members.txt", f"{d}/term.txt", f"{d}/corr.txt")
    atoms = {(r.resname, r.atomname, r.serial) for r in topo.atoms.collect()}
    assert atoms == {("AAA", N, 1), ("AAA", CA, 2), ("AAA", C, 3), ("AAA", " H1 ", 4), ("AAA", " H3 ", 5)}
    dirs = {(r.resname, r.siteid, r.sitetype, r.atom1, r.atom2, r.atom3) for r in topo.directors.collect()}
    assert dirs == {("AAA", 0, 0, CA, C, N), ("BBB", 0, 0, CA, C, N), ("BBB", 1, 0, CG, CD, CB)}
    mem = {(r.resname, r.atomname, r.siteid) for r in topo.members.collect()}
    assert ("BBB", CD, 1) in mem and len(mem) == 8  # trailing "xx" ignored
    t = topo.terminus.collect()[0]
    assert (t.atom1, t.atom2, t.atom3) == (C, O, OXT)
    assert [(r.resname, r.atom1, r.atom2) for r in topo.corrections.collect()] == [("BBB", CB, CG)]
    bonds = {(r.resname, r.selfserial, r.serial1, r.serial2) for r in T.read_bonds(spark, f"{d}/tmpl").collect()}
    assert ("AAA", 2, 1, 3) in bonds and ("AAA", 1, 4, None) in bonds and ("AAA", 5, 1, None) in bonds


def test_run_writes_five_tables(spark):
    from helpers import lines_df, topology

    d = tempfile.mkdtemp(prefix="orisite-out-")
    lines = ["DBREF  1ABC"]
    for r in range(3):
        for i, a in enumerate([N, CA, C, O, CB] + ([OXT] if r == 2 else [])):
            lines.append(atom(10 * r + i, a, "AAA", "A", r + 1, r * 3.8 + i * 0.9, (i % 3) * 0.8, (i % 2) * 1.1))
    paths = run(spark, lines_df(spark, {"good": lines, "bad": lines[1:]}), topology(spark), d)
    errs = spark.read.parquet(paths["pdb_file_error_table"]).collect()
    assert [(r.entry, r.reason) for r in errs] == [("bad", "No DBREF entry found")]
    assert spark.read.parquet(paths["pdb"]).count() == len(lines) - 1
    assert spark.read.parquet(paths["cg"]).count() == 4  # 3 residues + terminus site
    assert spark.read.parquet(paths["rmsd"]).count() > 0


def test_same_entry_name_in_two_folders_is_rejected(spark):
    from helpers import topology
    from orisite.plans.pipeline import check_lines

    d = tempfile.mkdtemp(prefix="orisite-dup-")
    lines = ["DBREF  1ABC", atom(1, N, "AAA", "A", 1, 1, 2, 3)]
    _write(f"{d}/x/pdb1abc.ent", "\n".join(lines) + "\n")
    _write(f"{d}/y/pdb1abc.ent", "\n".join(lines) + "\n")
    _write(f"{d}/y/pdb2xyz.ent", "\n".join(lines) + "\n")
    errs = {(r.entry, r.reason) for r in check_lines(read_structure_lines(spark, d), topology(spark)).errors.collect()}
    assert errs == {("pdb1abc.ent", "Duplicate entry")}


def test_large_files_are_read_by_many_tasks_with_dense_line_numbers(spark, tmp_path):
    """Files over several splits beside small ones, with either line end, blank lines and no final end."""
    from orisite.sources.structures import split_offsets

    want, root = {}, str(tmp_path / "s")
    for name, n, end, last in (("big1.ent", 9000, "\n", True), ("big2.pdb", 7000, "\r\n", False), ("blank.brk", 60000, "\n", True),
                               ("small.ent", 5, "\r\n", True), ("open.ent", 3, "\n", False), ("none.ent", 0, "\n", False)):
        lines = ["" if name == "blank.brk" or i % 7 == 3 else f"ATOM  {name} {i} ü\rx" for i in range(n)]
        if n and not last:
            lines[-1] = "END"
        _write(f"{root}/{name[:1]}/{name}", "")
        with open(f"{root}/{name[:1]}/{name}", "w", newline="") as f:
            f.write(end.join(lines) + (end if last else ""))
        want[name] = lines
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for broadcast in (1000, 0):
            got = read_structure_lines(spark, root, whole_bytes=10_000, broadcast_splits=broadcast)
            found = {}
            for r in got.collect():
                found.setdefault(r.entry, {})[r.line_no] = r.line
            found.pop("none.ent", None)
            assert {k: [v[i] for i in range(len(v))] for k, v in found.items()} == {k: v for k, v in want.items() if v}
        tasks = got.where("entry = 'big1.ent'").select(F.spark_partition_id()).distinct().count()
        assert tasks > 3 and "Window" not in got._jdf.queryExecution().executedPlan().toString()
        assert read_structure_lines(spark, root).count() == got.count()  # all of them whole
        spark.conf.set("spark.sql.files.maxPartitionBytes", "31k")
        with pytest.raises(Exception, match="other splits"):  # counted by one cut, read by another
            got.where("line <> '-'").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert split_offsets(spark.createDataFrame([], "file_path string, _start long, _part int, _id long")).count() == 0


def test_a_failed_refresh_leaves_the_tables_of_the_run_before(spark, tmp_path, monkeypatch):
    from orisite.sources import sinks

    out, names = str(tmp_path / "out"), [f"t{i}" for i in range(6)]
    with pytest.raises(FileNotFoundError):
        sinks.result_paths(spark, out)

    def tables(run):
        return {n: spark.createDataFrame([(run, n)], "run int, name string") for n in names}

    def seen():
        found = sinks.read_results(spark, out)
        return {(r.run, n == r.name) for n in found for r in found[n].collect()}, list(found)

    first = sinks.publish(spark, out, tables(1))
    assert seen() == ({(1, True)}, names)
    broken = tables(2) | {"t3": spark.range(1).select(F.raise_error(F.lit("fourth write")).cast("string").alias("x"))}
    with pytest.raises(Exception, match="fourth write"):
        sinks.publish(spark, out, broken)
    assert seen() == ({(1, True)}, names) and sinks.result_paths(spark, out) == first
    during, point = [], sinks._point

    def watched(*a):  # all of the new version is written, and nobody sees it yet
        during.append(seen())
        point(*a)

    monkeypatch.setattr(sinks, "_point", watched)
    sinks.publish(spark, out, tables(3))
    assert during == [({(1, True)}, names)] and seen() == ({(3, True)}, names)
    assert spark.read.parquet(first["t0"]).count() == 1  # a reader of the version before may finish
    sinks.publish(spark, out, tables(4))
    assert seen() == ({(4, True)}, names) and not os.path.exists(first["t0"]) and len(os.listdir(f"{out}/versions")) == 2
    assert sorted(os.listdir(out)) in (["CURRENT.json", "versions"], [".CURRENT.json.crc", "CURRENT.json", "versions"])


ROWS = dict(atoms=[("AAA", N, 1), ("AAA", CA, 2)], directors=[("AAA", 0, 0, CA, C, N)], members=[("AAA", N, 0), ("AAA", CA, 0)],
            terminus=[(C, O, OXT)], corrections=[("AAA", CB, CA)])
REPEATS = dict(atoms=("AAA", CA, 9), directors=("AAA", 0, 1, CA, C, O), members=("AAA", CA, 1), terminus=(C, CA, N), corrections=("AAA", CB, N))


@pytest.mark.parametrize("table", list(ROWS))
@pytest.mark.parametrize("same", [True, False])
def test_repeated_topology_keys_are_refused(spark, table, same):
    from helpers import lines_df
    from orisite.plans.pipeline import check_lines

    sound = T.Topology.from_rows(spark, **ROWS)
    assert sound.require_keys() is sound and sound.key_conflicts().count() == 0
    row = ROWS[table][-1] if same else REPEATS[table]
    topo = T.Topology.from_rows(spark, **ROWS | {table: [*ROWS[table], row]}, add_terminal_hydrogens=table != "atoms")
    bad = topo.key_conflicts().collect()
    assert [(r.table, r.rows, r.variants) for r in bad] == [(table, 2, 1 if same else 2)]
    with pytest.raises(ValueError, match=f"{table} .* 2 times"):
        check_lines(lines_df(spark, {"e": ["DBREF  1ABC"]}), topo)


@pytest.mark.parametrize("name, line, reason", [
    ("dirs", "ALAx0 CA  C   N  ", "unreadable site count"), ("dirs", "ALA00 CA  C   N  ", "no sites"), ("dirs", "ALA10 CA  C   N", "line too short"),
    ("dirs", "ALA1x CA  C   N  ", "unreadable site type"), ("dirs", "ALA10 CA      N  ", "blank atom name"), ("dirs", "AL", "unreadable site count"),
    ("members", "ALA", "no members"), ("members", "ALA N  0 CA ", "cut member"), ("members", "ALA N  x", "unreadable site id"),
    ("members", "ALA    0", "blank atom name"), ("corr", "ALA CB  CG", "line too short"), ("corr", "ALA     CG ", "blank atom name"),
    ("term", " C  \n O  \n", "missing line"), ("term", " C  \n O  \n OX\n", "short atom name"),
    ("tmpl/AAA.pdb", "ATOM  xxxxx  CA  AAA A   0", "unreadable serial"), ("tmpl/AAA.pdb", "ATOM      9  CA", "line too short")])
def test_unreadable_parameter_lines_stop_the_run(spark, tmp_path, name, line, reason):
    d = str(tmp_path)
    _topology_files(d)
    path = f"{d}/{name}" if "/" in name else f"{d}/{name}.txt"
    with open(path, "w" if name == "term" else "a") as f:
        f.write(f"{line}\n   \n" if name != "term" else line)
    args = (spark, f"{d}/tmpl", f"{d}/dirs.txt", f"{d}/members.txt", f"{d}/term.txt", f"{d}/corr.txt")
    assert [r.reason for r in T.topology_rejects(*args).collect()] == [reason]
    with pytest.raises(ValueError, match=reason):
        T.read_topology(*args)


def test_bond_faults(spark):
    lines = spark.createDataFrame([("f", i, line) for i, line in enumerate([
        *(atom(k, n, "AAA", "A", 0, 0, 0, 0) for k, n in ((1, N), (2, CA), (3, C))),
        "CONECT    1    2", "CONECT    2    1    3", "CONECT    3    2    9", "CONECT    3    1xx", "CONECT    x    1"])],
        "entry string, line_no long, line string")
    atoms = T.parse_template_atoms_with_position(lines)
    bonds = T.bonds_with_residues(lines, atoms)
    edges = T.bond_edges(bonds)
    assert (3, 1) not in {(r.src, r.dst) for r in edges.collect()} and bonds.where("malformed").count() == 2
    faults = T.bond_faults(edges, T.with_terminal_hydrogens(atoms.select("resname", "atomname", "serial")))
    assert {(r.src, r.dst, r.fault) for r in faults.collect()} == {(3, 9, "unknown target"), (3, 9, "one-way")}

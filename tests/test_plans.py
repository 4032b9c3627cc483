"""Physical plan shape: no Python evaluation anywhere, and the per-residue joins after
numbering reuse the residue-key bucketing instead of shuffling the atoms again."""

import os
import random
import re

from pyspark.sql import functions as F

from helpers import lines_df, topology
from orisite.operators import numbering
from orisite.operators.quality import check_entries, duplicate_atoms, repeated_atoms
from orisite.operators.sites import site_positions
from orisite.plans.pipeline import analyse_lines
from orisite.session import Materializer, dealt_by
from orisite.sources.structures import scan_records
from test_pipeline import _entries


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_and_colocated_residue_joins(spark):
    errors, st = analyse_lines(spark, lines_df(spark, _entries(n_entries=3)), topology(spark),
                               materialize=Materializer(spark))
    for df in (errors, st.relative, st.rmsd, st.cov):
        p = _plan(df)
        assert "EvalPython" not in p and "PythonUDF" not in p and "FlatMapGroupsInPandas" not in p
    rel = _plan(st.relative)
    assert "Exchange" not in rel, rel  # pdb x cg on (residue key, siteid): both bucketed on the residue key
    assert "BroadcastExchange" in _plan(st.residuals)  # cov is broadcast (one row per correction)


def test_rejected_entries_go_without_a_shuffle_of_the_atoms(spark):
    entries = _entries(n_entries=4)
    entries["e1"] = entries["e1"][1:]  # no DBREF line
    entries["e3"].append("MODEL        1")
    off = {k: "-1" for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    old = {k: spark.conf.get(k, None) for k in off}
    rows = []
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        for limit in (0, 100):
            chk = check_entries(scan_records(lines_df(spark, entries)), topology(spark), materialize=Materializer(spark),
                                broadcast_entries=limit)
            p = _plan(chk.clean)
            assert "Exchange hashpartitioning" not in p, p
            assert ("BroadcastExchange" in p) == (limit > 0), p
            rows.append(sorted(map(tuple, chk.clean.collect())))
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert rows[0] == rows[1] and {r[0] for r in rows[0]} == {"e0", "e2"}
    lazy = check_entries(scan_records(lines_df(spark, entries)), topology(spark))
    assert sorted(map(tuple, lazy.clean.collect())) == rows[0]


def _atoms(spark, entries):
    rows = [(e, n, c, s, i) for e, lines in entries.items() for n, c, s, i in lines]
    return spark.createDataFrame(rows, "entry string, line_no long, chainid string, resseq int, icode string")


def _counter(lines):
    out, last = [], None
    for _, c, s, i in sorted(lines):
        step = 0 if last is None else 1 if c != last[0] else s - last[1] if s > last[1] else int(s == last[1] and i != last[2])
        out.append((out[-1] if out else 0) + step)
        last = (c, s, i)
    return out


def test_blocks_are_full_whatever_the_line_numbers_and_levels_agree(spark):
    rng = random.Random(2)
    entries = {"huge": [], "mid": [], "short": []}
    for e, n in (("huge", 700), ("mid", 40), ("short", 9)):
        at = 0
        for _ in range(n):
            at += rng.choice([1, 1, 5, 10 ** 6, 10 ** 9])  # sparse numbers
            entries[e].append((at, rng.choice("AAAB"), rng.randrange(50), rng.choice("  x")))
    atoms = _atoms(spark, entries)
    for size in (7, 10, 64):
        b = numbering.blocked(atoms, size).groupBy("entry").agg(F.countDistinct("_blk").alias("blocks"), F.max("_ord").alias("last"), F.count("*").alias("n"))
        for r in b.collect():
            assert r.blocks == -(-r.n // size) and r.last == r.n - 1
        assert numbering.blocked(atoms, size).groupBy("entry", "_blk").count().agg(F.max("count")).first()[0] <= size
    want = sorted((e, c) for e, lines in entries.items() for c in _counter(lines))
    for size, group in ((1, 2), (7, 3), (10, 4096), (64, 2), (1 << 16, 4096)):
        m = Materializer(spark, buckets=3)
        got = numbering.scan_residues(atoms, size, m, group_blocks=group)
        assert sorted((r.entry, r.rescounter) for r in got.collect()) == want, (size, group)
        m.drop()


def test_short_entries_need_no_blocks(spark):
    p = _plan(numbering.number_residues(_atoms(spark, {"e": [(1, "A", 1, " ")], "f": [(5, "A", 2, " ")]})))
    assert "Join" not in p and "rangepartitioning" not in p and len(re.findall(r"hashpartitioning\(entry#\d+, \d+\)", p)) == 1, p


def test_bucketed_writes_make_one_file_a_bucket_and_no_needless_shuffle(spark, tmp_path):
    rows = spark.range(0, 5000, 1, 16).selectExpr("id", "cast(id % 97 as string) k")
    m = Materializer(spark, buckets=40)
    m(rows, "t", ["k"])  # 16 tasks, 40 buckets
    files = [f for _, _, names in os.walk(f"{m.root.removeprefix('file:')}/t") for f in names if f.startswith("part-")]
    assert len(files) <= 40 and spark.table(m.tables[0]).count() == 5000
    again = spark.table(m.tables[0])
    assert dealt_by(rows.repartition(40, "k"), 40, ["k"]) and not dealt_by(rows.repartition(40, "k", "id"), 40, ["k"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = again.join(again.groupBy("k").count(), "k")
        assert "Exchange" not in _plan(joined) and dealt_by(joined, 40, ["k"]) and not dealt_by(joined, 41, ["k"])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    m.drop()


def test_atoms_meet_their_roles_on_both_names(spark):
    _, st = analyse_lines(spark, lines_df(spark, _entries(n_entries=2)), topology(spark), materialize=Materializer(spark))
    p = _plan(site_positions(st.pdb, topology(spark)))
    assert re.search(r"BroadcastHashJoin \[resname#\d+, atomname#\d+\]", p) and re.search(r"BroadcastHashJoin \[atomname#\d+\]", p), p


def test_repeats_are_found_without_ordering_the_atoms(spark):
    entries = _entries(n_entries=3)
    atom_line = entries["e1"][3]
    entries["e1"] += [atom_line, atom_line]
    m = Materializer(spark)
    chk = check_entries(scan_records(lines_df(spark, entries)), topology(spark), materialize=m)
    assert not re.search(r"\bSort\b|Window", _plan(repeated_atoms(chk.numbered))) and "Exchange" not in _plan(repeated_atoms(chk.numbered))
    assert repeated_atoms(chk.numbered).count() == 1  # two copies among the last residue's atoms, the first out of order
    assert {r.entry: r.reason for r in chk.errors.collect()} == {"e1": "Residue indices out of order"}
    entries = _entries(n_entries=3)
    entries["e1"] += [entries["e1"][-1]] * 2
    chk = check_entries(scan_records(lines_df(spark, entries)), topology(spark), materialize=m)
    assert {r.entry: r.reason for r in chk.errors.collect()} == {"e1": "Duplicate atom"}
    assert sorted((r.entry, r.occurrence) for r in duplicate_atoms(chk.numbered).collect()) == [("e1", 2), ("e1", 3)]
    m.drop()

"""Rows that come in whole entries: nothing of the atoms' size is shuffled or written, and the rows are the same."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from helpers import lines_df, topology
from orisite.operators.numbering import mark_chain_ends, number_residues
from orisite.operators.quality import duplicate_atoms
from orisite.plans import derived
from orisite.plans.pipeline import analyse_lines, check_lines
from orisite.session import Materializer, lies_whole, settled
from orisite.sources.structures import read_structure_lines, scan_atoms
from test_pipeline import _entries
from test_plans import _plan
from test_session import MORE_ITEMS, _line_items
from tools.oracle_check import _canon


def _faulty():
    entries = _entries(n_entries=6)
    entries["e1"] = entries["e1"][1:]  # no DBREF line
    entries["e2"].append("MODEL        1")
    entries["e3"] += [entries["e3"][-1]] * 2
    entries["e4"].append(entries["e4"][1][:20])  # cut
    return entries


def _whole(spark, m, df):
    return m(df.withColumnRenamed("entry", "e"), "whole", ["e"]).withColumnRenamed("e", "entry")


def test_rows_in_buckets_of_entries_lie_whole(spark):
    m = Materializer(spark, buckets=3)
    df = lines_df(spark, _entries(n_entries=3))
    t = _whole(spark, m, df)
    assert lies_whole(t, "entry") and not lies_whole(df, "entry") and not lies_whole(t, "line_no")
    assert lies_whole(df.repartition(7, "entry"), "entry") and not lies_whole(df.repartition(7, "entry", "line_no"), "entry")
    assert lies_whole(t.unionByName(t.select("entry").distinct().select("entry", F.lit(0).cast("long").alias("line_no"), F.lit("x").alias("line"))), "entry")
    m.drop()


@pytest.mark.parametrize("block_lines", [1 << 16, 4])  # 4: long entries go by blocks
def test_checks_and_stages_of_whole_entries_are_those_of_dealt_ones(spark, block_lines):
    topo, m = topology(spark), Materializer(spark, buckets=3)
    df = lines_df(spark, _faulty())
    lines = settled(_whole(spark, m, df), ["line"])
    other = Materializer(spark, buckets=3)
    a, b = check_lines(lines, topo, block_lines, m), check_lines(df, topo, block_lines, other)
    for x, y in ((a.errors, b.errors), (a.clean, b.clean), (duplicate_atoms(a.numbered), duplicate_atoms(b.numbered))):
        assert sorted(map(tuple, x.select(*y.columns).collect())) == sorted(map(tuple, y.collect()))
    assert {r.entry: r.reason for r in a.errors.collect()} == {
        "e1": "No DBREF entry found", "e2": "Ensemble of models", "e3": "Duplicate atom", "e4": "Malformed ATOM record"}
    if block_lines > 4:
        assert "Exchange hashpartitioning" not in _plan(a.clean)
    m.drop()
    other.drop()


def test_stages_of_whole_entries_are_not_written(spark):
    topo, m = topology(spark), Materializer(spark, buckets=3)
    df = lines_df(spark, _entries(n_entries=6))
    _, st = analyse_lines(spark, settled(_whole(spark, m, df), ["line"]), topo, materialize=m)
    other = Materializer(spark, buckets=3)
    _, far = analyse_lines(spark, df, topo, materialize=other)
    for name in ("pdb", "cg", "relative"):
        x, y = getattr(st, name), getattr(far, name)
        assert _canon(x.toPandas()).equals(_canon(y.toPandas())), name
        assert "Exchange hashpartitioning(entry" not in _plan(x), name
    for name in ("moments", "pairs", "cov", "rmsd"):
        x, y = (derived._r(getattr(s, name)).toPandas() for s in (st, far))
        assert len(x) and _canon(x).equals(_canon(y)), name
    m.drop()
    other.drop()


def test_chain_ends_of_whole_entries_with_nulls(spark):
    rows = [("e", "A", 0), ("e", "A", 3), ("e", None, 4), ("f", "B", 2), (None, "A", 1), ("f", "B", None)]
    a = spark.createDataFrame(rows, "entry string, chainid string, rescounter int").withColumn("x", F.lit(1))
    want, got = mark_chain_ends(a), mark_chain_ends(a.repartition(3, "entry"))
    assert got.columns == want.columns and "Join" not in _plan(got)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_numbering_leaves_whole_entries_where_they_are(spark):
    rows = [(f"e{i}", n, "A", n // 2, " ") for i in range(5) for n in range(6)]
    a = spark.createDataFrame(rows, "entry string, line_no long, chainid string, resseq int, icode string")
    got = number_residues(a.repartition(3, "entry"))
    assert _plan(got).count("Exchange") == 1 and lies_whole(got, "entry")
    assert sorted(map(str, got.collect())) == sorted(map(str, number_residues(a).select(*got.columns).collect()))


def test_settled_columns_are_computed_once(spark):
    df = settled(spark.range(3).select("id", F.concat(F.lit("a"), F.col("id").cast("string")).alias("line")), ["line"])
    p = _plan(df.filter(F.col("line").startswith("a1") & (F.length("line") > 1)).select("line"))
    assert p.count("concat") == 1 and p.index("Filter") < p.index("Generate"), p
    p = _plan(scan_atoms(settled(lines_df(spark, _entries(n_entries=1)), ["line"])))
    assert p.count("RLIKE") == 4, p


def test_the_derived_sources_lie_whole_and_write_only_line_items(spark, tmp_path):
    sf = _line_items(spark, tmp_path, MORE_ITEMS)
    c = derived.Ctx(spark, sf)
    for name in ("structure_atoms", "structure_lines", "qc_lines"):
        assert lies_whole(c.source(name), "entry") and "Exchange hashpartitioning" not in _plan(c.source(name).groupBy("entry").count())
        assert c.places(name).count() == c.source(name).count()
    st = c.stages()
    assert st.rmsd.count() and {*os.listdir(c.mat.root.removeprefix("file:"))} == {"items", "moments", "pairs", "cov"}
    c.mat.drop()


def test_compressed_structure_files(spark, tmp_path):
    text = "ATOM  a\nATOM  b\n"
    (tmp_path / "x.ent").write_text(text)
    for name in ("y.ent.gz", "z.txt.gz"):
        (tmp_path / name).write_bytes(gzip.compress(text.encode()))
    got = {r.entry for r in read_structure_lines(spark, str(tmp_path)).collect()}
    assert got == {"x.ent"}
    for whole_bytes in (1 << 20, 20):  # 20: both by line
        rows = read_structure_lines(spark, str(tmp_path), whole_bytes, compressed=True).collect()
        assert sorted((r.entry, r.line_no, r.line) for r in rows) == [
            (e, i, f"ATOM  {x}") for e in ("x.ent", "y.ent.gz") for i, x in enumerate("ab")]


@pytest.mark.parametrize("name", ["read_files", "pipeline_rmsd", "rmsd_report", "scan_atoms", "site_positions", "to_site_frame"])
def test_more_queries_give_the_rows_of_their_sql(spark, tmp_path, name):
    import duckdb

    from orisite.plans.oracle_sql import ORACLE

    sf = _line_items(spark, tmp_path, MORE_ITEMS)
    got = derived.QUERIES[name](spark, sf).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{sf}/lineitem.parquet/*.parquet')")
    assert _canon(got).equals(_canon(con.execute(ORACLE[name]).df()))
    Materializer.drop_all()


def test_no_generated_method_is_too_large_for_the_jvm_to_compile(spark):
    """Parsing a bond record as one method took 35 us a line: HotSpot interprets methods above 8,000 bytes."""
    from orisite.session import PLAN_CONF

    assert int(PLAN_CONF["spark.sql.codegen.hugeMethodLimit"]) <= 8000
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == PLAN_CONF["spark.sql.codegen.hugeMethodLimit"]

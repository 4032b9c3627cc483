"""Stage tables: the bucket count asked for is the one written, errors are raised, nothing is left
behind; and the derived inputs keep every line item."""

import pytest
from pyspark.sql import functions as F

from helpers import lines_df, topology
from orisite.operators.numbering import number_residues
from orisite.operators.sites import site_positions
from orisite.plans import derived
from orisite.plans.pipeline import run
from orisite.session import Materializer
from orisite.sources.structures import scan_records
from test_pipeline import _entries


def test_bucket_count_is_the_one_asked_for(spark):
    m = Materializer(spark, buckets=5)
    t = m(spark.range(100).withColumnRenamed("id", "k"), "t", ["k"])
    described = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {m.tables[0]}").collect()}
    assert described["Num Buckets"] == "5" and t.count() == 100
    m.drop()
    assert not [t for t in spark.catalog.listTables() if m.tag in t.name]


def test_a_failing_write_raises(spark):
    m = Materializer(spark)
    bad = spark.range(3).select(F.raise_error(F.lit("broken row")).cast("string").alias("k"))
    with pytest.raises(Exception, match="broken row"):
        m(bad, "t", ["k"])
    m.drop()


def test_run_drops_its_stages(spark, tmp_path):
    before = {t.name for t in spark.catalog.listTables()}
    run(spark, lines_df(spark, _entries(n_entries=2)), topology(spark), str(tmp_path / "out"))
    assert {t.name for t in spark.catalog.listTables()} == before


def test_every_line_item_is_a_residue(spark):
    sf = "/root/testdata/sf0.001"
    r = derived.residues(spark, sf)
    key = ["entry", "chainid", "resseq", "icode"]
    n = derived.lineitem(spark, sf).count()
    assert r.count() == n == r.select(*key).distinct().count()
    assert derived.structure_atoms(spark, sf).select(*key).distinct().count() == n


def test_chains_and_insertion_codes_are_compared_whole(spark):
    rows = [("e", i, c, s, ic) for i, (c, s, ic) in enumerate(
        [("AA", 1, "x1"), ("AB", 1, "x1"), ("AB", 1, "x2"), ("AC", 5, " "), ("AC", 7, " ")])]
    a = spark.createDataFrame(rows, "entry string, line_no long, chainid string, resseq int, icode string")
    for block in (1, 2, 100):
        got = number_residues(a, block).orderBy("line_no").collect()
        assert [r.rescounter for r in got] == [0, 1, 2, 3, 5]


def test_site_of_a_residue_with_two_names(spark):
    topo = derived.fixture_topology(spark)
    rows = [("e", "A", 0, n, a, True, float(i), 0.0, 0.0) for i, (n, a) in enumerate(
        [("AAA", " P2 "), ("BBB", " P5 "), ("AAA", " P6 ")])]
    a = spark.createDataFrame(rows, "entry string, chainid string, rescounter int, resname string, atomname string, "
                                    "is_end boolean, x double, y double, z double")
    got = site_positions(a, topo).filter("siteid = -1").collect()
    assert len(got) == 1 and got[0].resname == "AAA" and (got[0].a1x, got[0].a2x, got[0].a3x) == (0.0, 1.0, 2.0)


def test_only_decimal_numbers_are_numbers(spark):
    def line(x):
        return f"ATOM      1  CA  AAA A   1    {x:>8s}   1.000   1.000  1.00  0.00"

    values = ["1.0d", "2.5f", "0x1p3", "", "NaN", "1e2", "+.5", "-3."]
    lines = spark.createDataFrame([("e", i, line(v)) for i, v in enumerate(values)], "entry string, line_no long, line string")
    got = {r.line_no: (r.x, r.malformed_at) for r in scan_records(lines).collect()}
    assert [got[i] for i in range(5)] == [(None, 5)] * 5
    assert [got[i][0] for i in range(5, 8)] == [100.0, 0.5, -3.0]


LINE_ITEMS = [(o, 31 * o + n, 7 * n + o, n, "ANR"[n % 3], "OF"[o % 2]) for o in range(1, 9) for n in range(1, o % 4 + 2)]


def _line_items(spark, folder, rows=LINE_ITEMS):
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, "
                                "l_linestatus string").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_derived_queries_need_no_bucket_setting_on_a_cluster(spark, tmp_path, monkeypatch):
    from orisite import session

    sf = _line_items(spark, tmp_path)
    monkeypatch.setattr(session, "is_local", lambda s: False)
    with pytest.raises(ValueError, match="pass buckets"):
        Materializer(spark)
    before = len(Materializer._open)
    assert derived.QUERIES["correction_layout"](spark, sf).count() == len(LINE_ITEMS)
    assert len(Materializer._open) == before  # it writes no stage
    c = derived.Ctx(spark, sf)
    assert c.atoms().select("entry", "chainid", "rescounter").distinct().count() == len(LINE_ITEMS)
    assert c.mat is c.mat and c.mat.buckets == spark.sparkContext.defaultParallelism
    c.mat.drop()
    monkeypatch.setattr(derived, "BUCKET_BYTES", derived.ITEM_BYTES // 3)  # the count grows with the table
    assert derived.bucket_count(spark, sf) == -(-len(LINE_ITEMS) * derived.ITEM_BYTES // derived.BUCKET_BYTES)
    spark.conf.set(session.BUCKETS_CONF, 5)
    try:
        assert derived.bucket_count(spark, sf) == 5
    finally:
        spark.conf.unset(session.BUCKETS_CONF)


def test_terminus_layout_has_a_row_for_every_entry(spark, tmp_path):
    import duckdb

    from orisite.plans.oracle_sql import ORACLE

    sf = _line_items(spark, tmp_path, [r for r in LINE_ITEMS if (r[0], r[3]) != (7, 2)] + [(20, None, 4, 1, "A", "O"), (21, 5, 4, 6, "A", "O")])
    got = {r.entry: (r.atom1, r.atom2, r.atom3) for r in derived.QUERIES["terminus_layout"](spark, sf).collect()}
    assert set(got) == {*map(str, range(1, 9)), "20", "21"}
    assert got["3"] == (" T4 ", " T5 ", " T6 ") and got["7"] == (" T8 ", None, " T0 ")
    assert got["4"] == (" T5 ", None, None) and got["20"] == got["21"] == (None, None, None)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{sf}/lineitem.parquet/*.parquet')")
    assert {e: tuple(a) for e, *a in con.execute(ORACLE["terminus_layout"]).fetchall()} == got


CLUSTER_QUERIES = """assign_sites bond_edges bond_faults chain_ends clean_atoms corrected_predictor corrected_rmsd correction_layout
    direct_atoms direct_rmsd duplicate_atoms entry_errors fit_corrections fit_corrections_legacy_y fit_ranks frame_moments
    from_site_frame layout_rejects layout_rows number_residues orient_sites pipeline_errors""".split()
MORE_ITEMS = [(o, 97 * o + 13 * n, 41 * n + 29 * o, n, "ANR"[(o + n) % 3], "OF"[o % 2]) for o in range(1, 61) for n in range(1, o % 7 + 2)]
MORE_ITEMS += [(o, pk + 1, sk, n, flag, status) for o, pk, sk, n, flag, status in MORE_ITEMS if o % 5 == 0 and n == 1]  # repeated atoms


@pytest.mark.parametrize("name", CLUSTER_QUERIES)
def test_each_derived_query_gives_its_rows_on_a_cluster_without_settings(spark, tmp_path, monkeypatch, name):
    import duckdb

    from orisite import session
    from orisite.plans.oracle_sql import ORACLE
    from tools.oracle_check import _canon

    sf = _line_items(spark, tmp_path, MORE_ITEMS)
    monkeypatch.setattr(session, "is_local", lambda s: False)
    before = len(Materializer._open)
    got = derived.QUERIES[name](spark, sf).toPandas()
    for m in Materializer._open[before:]:
        m.drop()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{sf}/lineitem.parquet/*.parquet')")
    want = con.execute(ORACLE[name]).df()
    assert len(got) and sorted(got.columns) == sorted(want.columns) and _canon(got).equals(_canon(want))

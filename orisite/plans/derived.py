"""Structures derived from the driver's ``lineitem`` table, and the named queries on them.

The driver's tables hold no molecules, so residues are made from line items (one order = one
entry; return flag = chain; line number = residue number; line status = insertion code) and
atoms from a small topology of our own.  Coordinates are an offset per atom plus a
deterministic integer-hash jitter, turned by one of four exact rotations.  Everything is
column arithmetic on ``lineitem``, so the work grows with the table.  The same rules are
written in DuckDB SQL in ``oracle_sql.py``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orisite.functions.vec import V3
from orisite.operators import corrections as R
from orisite.operators.numbering import chain_ends, mark_chain_ends, number_residues
from orisite.operators.quality import check_entries, duplicate_atoms
from orisite.operators.report import corrected_rmsd, direct_rmsd, rmsd_report
from orisite.operators.sites import assign_sites, orient_sites, site_positions
from orisite.plans.pipeline import Stages, analyse_lines, check_lines
from orisite.session import BUCKETS_CONF, Materializer, lies_whole, settled
from orisite.sources import topology as T
from orisite.sources.sinks import publish, read_results
from orisite.sources.structures import read_structure_lines, scan_atoms, scan_records

# ---- fixed values of our own test topology -----------------------------------------------
# Atom name, serial and offset (x, y, z) of every template atom.
TEMPLATE = [
    (" P1 ", 1, 0.0, 0.0, 0.0),
    (" P2 ", 2, 1.5, 0.0, 0.0),
    (" P3 ", 3, -0.5, 1.4, 0.0),
    (" P4 ", 4, -0.5, -0.8, 1.2),
    (" P5 ", 5, 2.2, 1.0, 0.2),
    (" P6 ", 6, 2.1, -1.1, -0.3),
    (" Q1 ", 7, -1.0, -2.2, 2.0),
    (" Q2 ", 8, -2.4, -2.4, 2.3),
    (" Q3 ", 9, -0.6, -3.2, 1.0),
    (" Q4 ", 10, -0.7, -2.5, 3.1),
]
# Residue kind (l_partkey % 4) -> residue name and how many template atoms it has.
# In the clean entries the kind 3 is 4.
KINDS = [(0, "AAA", 6), (1, "BBB", 10), (2, "CCC", 10), (3, "ZZZ", 6), (4, "DDD", 6)]  # ZZZ is not in the topology
UNKNOWN_KIND, CLEAN_KIND = 3, 4
DIRECTORS = [("AAA", 0, 0, " P1 ", " P2 ", " P3 "), ("DDD", 0, 0, " P1 ", " P2 ", " P3 "),
             ("BBB", 0, 0, " P1 ", " P2 ", " P3 "), ("BBB", 1, 0, " Q1 ", " Q2 ", " P4 "),
             ("CCC", 0, 0, " P1 ", " P2 ", " P3 "), ("CCC", 1, 0, " Q1 ", " Q2 ", " P4 ")]
TERMINUS = [(" P2 ", " P5 ", " P6 ")]
CORRECTIONS = [("BBB", " P4 ", " Q1 "), ("BBB", " Q4 ", " P2 "), ("CCC", " P4 ", " Q3 ")]
# Jitter constants (a, b, d) per axis, modulus, amplitude; rotations (cos, sin) by l_suppkey % 4
# as exact fractions.
JITTER = {"x": (31, 17, 101), "y": (53, 29, 211), "z": (71, 43, 307)}
JITTER_MOD = 1009
JITTER_AMP = 0.3
ROTATIONS = [(3, 5, 4, 5), (5, 13, 12, 13), (8, 17, 15, 17), (1, 1, 0, 1)]
# QC variety rules: MODEL line, missing DBREF, renamed atom, alternate location, bad number,
# ignored HETATM record.
MODEL_EVERY, NO_DBREF_EVERY, RENAME_EVERY, ALTLOC_EVERY, BAD_X_EVERY, HETATM_EVERY = 13, 11, 17, 19, 29, 23
RENAMED_FROM, RENAMED_TO = " P3 ", " PX "
# Every so many residues (by l_suppkey) one atom bears another residue's name.
MIXED_EVERY, MIXED_ATOM, MIXED_NAME = 37, " P5 ", "BBB"
# Unreadable coordinates, chosen by l_suppkey.
BAD_X = ["  bad.xx", "    1.0d", "    2.5f", "   0x1p3", "        ", "     NaN"]
# Room for line numbers below those of a repeated line item.
REPEAT_STEP = 8
# Orders whose lines share one structure file.
FILE_ORDERS = 1000
# Bytes that the atoms of a line item take in memory (at most ten of some 130), and that a bucket should hold.
ITEM_BYTES, BUCKET_BYTES = 1300, 64 << 20
# Bits of the line order key: serial 4, icode 7, chain 7, residue number 3 (qc order) ...
QC_PART_SHIFT = 1 << 21
MODEL_SLOT_MOD = 2003


# Predictors of the rank query, by shape: as they are, in a plane, on a line, in a point (as SQL over
# px, py, pz); then turned by two exact rotations, shifted and scaled.
PREDICTOR_SHAPES = {"full": ("px", "py", "pz"), "plane": ("px", "py", "2e0 * px - py"), "line": ("px", "3e0 * px", "-px"),
                    "point": ("25e-2", "-5e-1", "1e0")}
PREDICTOR_SHIFT = (1000.0, -200.0, 50.0)
PREDICTOR_SCALES = {"small": 1e-6, "one": 1.0, "large": 1e6}


def fixture_topology(spark: SparkSession) -> T.Topology:
    atoms = [(res, name, serial) for k, res, n in KINDS if k != UNKNOWN_KIND for name, serial, *_ in TEMPLATE[:n]]
    members = [(res, name, 0 if name.startswith(" P") else 1) for res, name, _ in atoms]
    return T.Topology.from_rows(spark, atoms=atoms, directors=DIRECTORS, members=members,
                                terminus=TERMINUS, corrections=CORRECTIONS)


def template_df(spark: SparkSession) -> DataFrame:
    rows = [(k, res, name, serial, ox, oy, oz)
            for k, res, n in KINDS for name, serial, ox, oy, oz in TEMPLATE[:n]]
    return spark.createDataFrame(rows, "kind int, resname string, atomname string, serial int, "
                                       "ox double, oy double, oz double")


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six columns used, read as they are stored.  The benchmark's table is one row group,
    which one task would read and unfold; ``bench.py`` has it spread over so many tasks by the
    setting ``spark.orisite.spread``."""
    li = spark.read.parquet(f"{sf_dir.rstrip('/')}/lineitem.parquet").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")
    spread = spark.conf.get("spark.orisite.spread", None)
    return li.repartition(int(spread)) if spread else li


def bucket_count(spark: SparkSession, sf_dir: str) -> int:
    """Buckets of the stage tables that are derived from ``lineitem``: what ``spark.orisite.buckets`` asks
    for, else the size of the atom table over that of a bucket, one for each core at least."""
    if asked := spark.conf.get(BUCKETS_CONF, None):
        return int(asked)
    items = lineitem(spark, sf_dir).count()  # from the footers of the files
    return max(spark.sparkContext.defaultParallelism, -(-items * ITEM_BYTES // BUCKET_BYTES))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line items with the name of their entry."""
    return lineitem(spark, sf_dir).select(F.col("l_orderkey").cast("string").alias("entry"), "l_partkey", "l_suppkey",
                                          "l_linenumber", "l_returnflag", "l_linestatus")


def residues(spark: SparkSession, sf_dir: str, li: DataFrame | None = None) -> DataFrame:
    """One residue for each line item (``li``, see ``items``).  Its number is the line number, with a step added for
    each earlier item (by partkey, suppkey) of the same order, flag, line number and status."""
    same = Window.partitionBy("entry", "l_returnflag", "l_linenumber", "l_linestatus").orderBy("l_partkey", "l_suppkey")
    return (items(spark, sf_dir) if li is None else li).withColumn("_again", F.row_number().over(same) - 1).select(
        "entry", F.col("l_returnflag").alias("chainid"),
        (F.col("l_linenumber") + REPEAT_STEP * F.col("_again")).cast("int").alias("resseq"),
        F.col("l_linestatus").alias("icode"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"))


def _jitter(axis: str) -> Column:
    a, b, d = JITTER[axis]
    s = F.col("serial")
    q = (F.col("pk") * (a + 7 * s) + F.col("sk") * (b + 11 * s) + d * s) % JITTER_MOD
    return (q.cast("double") / float(JITTER_MOD) - 0.5) * JITTER_AMP


def _rot() -> tuple[Column, Column]:
    k = F.col("sk") % 4
    c = s = None
    for i, (cn, cd, sn, sd) in enumerate(ROTATIONS):
        cv, sv = F.lit(float(cn)) / F.lit(float(cd)), F.lit(float(sn)) / F.lit(float(sd))
        c = F.when(k == i, cv) if c is None else c.when(k == i, cv)
        s = F.when(k == i, sv) if s is None else s.when(k == i, sv)
    return c, s


def with_coordinates(df: DataFrame) -> DataFrame:
    """Adds x, y, z from (pk, sk, serial, ox, oy, oz)."""
    c, s = _rot()
    df = df.select("*", (F.col("ox") + _jitter("x")).alias("_x0"), (F.col("oy") + _jitter("y")).alias("_y0"),
                   (F.col("oz") + _jitter("z")).alias("_z0"), c.alias("_c"), s.alias("_s"))
    x0, y0, z0, c, s = (F.col(n) for n in ("_x0", "_y0", "_z0", "_c", "_s"))
    df = df.select("*", (c * x0 - s * y0).alias("x"), (s * x0 + c * y0).alias("_y1"))
    y1 = F.col("_y1")
    return df.select("*", (c * y1 - s * z0).alias("y"), (s * y1 + c * z0).alias("z")).drop(
        "_x0", "_y0", "_z0", "_c", "_s", "_y1")


def _keep_atom() -> Column:
    """P6 is missing when l_suppkey % 3 = 0 (no terminus site there)."""
    return ~((F.col("atomname") == " P6 ") & (F.col("sk") % 3 == 0))


def structure_atoms(spark: SparkSession, sf_dir: str, li: DataFrame | None = None) -> DataFrame:
    """Clean residues with their atoms: entry, line_no, chainid, resseq, icode,
    resname, atomname, serial, x, y, z.  Line order = (chain, residue number, insertion code,
    serial)."""
    tmpl = F.broadcast(template_df(spark).filter(F.col("kind") != UNKNOWN_KIND))
    kind = (F.col("pk") % 4).cast("int")
    r = residues(spark, sf_dir, li).withColumn("kind", F.when(kind == UNKNOWN_KIND, CLEAN_KIND).otherwise(kind))
    a = r.join(tmpl, "kind").filter(_keep_atom())
    a = with_coordinates(a)
    line_no = (((F.ascii("chainid").cast("long") * 4096 + F.col("resseq")) * 128 + F.ascii("icode")) * 16
               + F.col("serial"))
    mixed = (F.col("sk") % MIXED_EVERY == 5) & (F.col("atomname") == MIXED_ATOM)
    return a.select("entry", line_no.alias("line_no"), "chainid", "resseq", "icode",
                    F.when(mixed, MIXED_NAME).otherwise(F.col("resname")).alias("resname"), "atomname",
                    "serial", "x", "y", "z")


# ---- fixed-width text -----------------------------------------------------------------

def millis(v: Column) -> Column:
    """Integer thousandths (round half away from zero, as every engine does for doubles)."""
    return F.round(v * 1000.0).cast("long")


def fmt_coord(m: Column) -> Column:
    """8-wide, 3 decimals, from integer thousandths ``m`` (exact, same in every engine)."""
    a = F.abs(m)
    txt = F.concat(F.when(m < 0, F.lit("-")).otherwise(F.lit("")), ((a - a % 1000) / 1000).cast("long").cast("string"),
                   F.lit("."), F.lpad((a % 1000).cast("string"), 3, "0"))
    return F.lpad(txt, 8, " ")


def with_millis(df: DataFrame) -> DataFrame:
    return df.select("*", millis(F.col("x")).alias("_mx"), millis(F.col("y")).alias("_my"),
                     millis(F.col("z")).alias("_mz"))


def atom_line(record: Column, serial: Column, atomname: Column, altloc: Column, resname: Column,
              chainid: Column, resseq: Column, icode: Column, x: Column, y: Column, z: Column) -> Column:
    return F.concat(record, F.lpad(serial.cast("string"), 5, " "), F.lit(" "), atomname, altloc, resname,
                    F.lit(" "), chainid, F.lpad(resseq.cast("string"), 4, " "), icode, F.lit("   "),
                    x, y, z, F.lit("  1.00  0.00"))


def structure_lines(spark: SparkSession, sf_dir: str, li: DataFrame | None = None) -> DataFrame:
    """Clean text entries: one DBREF line, then the ATOM lines of ``structure_atoms``."""
    a = structure_atoms(spark, sf_dir, li)
    atoms = with_millis(a).select("entry", "line_no", atom_line(
        F.lit("ATOM  "), F.col("serial"), F.col("atomname"), F.lit(" "), F.col("resname"), F.col("chainid"),
        F.col("resseq"), F.col("icode"), fmt_coord(F.col("_mx")), fmt_coord(F.col("_my")),
        fmt_coord(F.col("_mz"))).alias("line"))
    dbref = a.select("entry").distinct().select("entry", F.lit(0).cast("long").alias("line_no"),
                                                F.concat(F.lit("DBREF  "), F.col("entry")).alias("line"))
    return dbref.unionByName(atoms)


def qc_lines(spark: SparkSession, sf_dir: str, li: DataFrame | None = None, by: tuple[str, ...] = ("entry",)) -> DataFrame:
    """Text entries with every kind of defect: all line items (repeats included), lines in
    (part, line number, flag, status) order so residue numbers can fall, unknown residue
    kind, renamed atoms, alternate locations, unreadable coordinates, MODEL lines, missing
    DBREF lines and ignored HETATM records.  ``by``: the entry, and columns of ``li`` that it settles."""
    li = (items(spark, sf_dir) if li is None else li).select(
        *by, F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"),
        F.col("l_linenumber").alias("resseq"), F.col("l_returnflag").alias("chainid"),
        F.col("l_linestatus").alias("icode"), (F.col("l_partkey") % 4).cast("int").alias("kind"))
    a = li.join(F.broadcast(template_df(spark)), "kind").filter(_keep_atom())
    a = with_millis(with_coordinates(a))
    base = ((((F.col("pk") * 8 + F.col("resseq")) * 128 + F.ascii("chainid")) * 128 + F.ascii("icode")) * 16)
    name = F.when((F.col("sk") % RENAME_EVERY == 0) & (F.col("atomname") == RENAMED_FROM),
                  F.lit(RENAMED_TO)).otherwise(F.col("atomname"))
    alt = F.when(F.col("pk") % ALTLOC_EVERY == 0, F.lit("A")).otherwise(F.lit(" "))
    bad = F.get(F.array(*map(F.lit, BAD_X)), (F.col("sk") % len(BAD_X)).cast("int"))
    xs = F.when((F.col("pk") % BAD_X_EVERY == 0) & (F.col("serial") == 1), bad).otherwise(fmt_coord(F.col("_mx")))
    atoms = a.select(*by, (base + F.col("serial")).alias("line_no"), atom_line(
        F.lit("ATOM  "), F.col("serial"), name, alt, F.col("resname"), F.col("chainid"), F.col("resseq"),
        F.col("icode"), xs, fmt_coord(F.col("_my")), fmt_coord(F.col("_mz"))).alias("line"))
    het = a.filter((F.col("sk") % HETATM_EVERY == 0) & (F.col("serial") == 1)).select(
        *by, (base + 15).alias("line_no"), atom_line(
            F.lit("HETATM"), F.col("serial"), F.col("atomname"), F.lit(" "), F.lit("ZZZ"), F.col("chainid"),
            F.col("resseq"), F.col("icode"), fmt_coord(F.col("_mx")), fmt_coord(F.col("_my")),
            fmt_coord(F.col("_mz"))).alias("line"))
    # both lines of an entry come from one list, since a filter by entry would tell the planner less about the rows' places
    ok = F.col("entry").cast("long")
    def head(when, line_no, line):
        return F.when(when, F.struct(line_no.cast("long").alias("line_no"), line.alias("line")))
    heads = F.array(head(ok % NO_DBREF_EVERY != 0, F.lit(0), F.concat(F.lit("DBREF  "), F.col("entry"))),
                    head(ok % MODEL_EVERY == 0, (ok * 31) % MODEL_SLOT_MOD * QC_PART_SHIFT, F.lit("MODEL        1")))
    heads = li.select(*by).distinct().select(*by, F.inline(F.filter(heads, lambda h: h.isNotNull())))
    return atoms.unionByName(het).unionByName(heads)


# ---- parameter-file layouts built from line items (S3-S8) ---------------------------------

def _digit(c: Column) -> Column:
    return (c % 10).cast("string")


def _res3(li: DataFrame) -> Column:
    return F.concat(F.lit("R"), F.lpad((F.col("l_partkey") % 100).cast("string"), 2, "0"))


def _mangled(line: Column) -> Column:
    """Every sixth line is cut, has an unreadable count, is blank, or lacks a name or what is before it."""
    k = F.col("l_suppkey") % 6
    return (F.when(k == 1, F.substring(line, F.lit(1), (F.col("l_partkey") % 20 + 2).cast("int")))
            .when(k == 2, F.concat(F.substring(line, 1, 3), F.lit("x"), F.substring(line, 5, 100)))
            .when(k == 3, F.lit("   ")).when(k == 4, F.concat(F.substring(line, 1, 5), F.lit("    "), F.substring(line, 10, 100)))
            .when(k == 5, F.concat(F.substring(line, 1, 3), F.lit("    "), F.substring(line, 8, 100))).otherwise(line))


def director_lines(spark: SparkSession, sf_dir: str, mangle: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    li = lineitem(spark, sf_dir)
    groups = [F.concat(((F.col("l_suppkey") + i) % 2).cast("string"),
                       *(F.concat(F.lit(" C"), _digit(F.col("l_partkey") + 3 * i + k), F.lit(" ")) for k in (1, 2, 3)))
              for i in range(3)]
    return li.select(mangle(F.concat(_res3(li), (1 + F.col("l_linenumber") % 3).cast("string"), *groups)).alias("line"))


def member_lines(spark: SparkSession, sf_dir: str, mangle: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    li = lineitem(spark, sf_dir)
    groups = [F.concat(F.lit(" M"), _digit(F.col("l_partkey") + i), F.lit(" "),
                       ((F.col("l_suppkey") + i) % 3).cast("string")) for i in range(8)]
    full = F.concat(_res3(li), *groups)
    n = 3 + 5 * F.col("l_linenumber") + F.col("l_suppkey") % 5
    return li.select(mangle(F.substring(full, F.lit(1), n.cast("int"))).alias("line"))


def correction_lines(spark: SparkSession, sf_dir: str, mangle: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    li = lineitem(spark, sf_dir)
    return li.select(mangle(F.concat(_res3(li), F.lit(" C"), _digit(F.col("l_partkey")), F.lit(" "),
                                     F.lit(" C"), _digit(F.col("l_suppkey")), F.lit(" "))).alias("line"))


def terminus_lines(spark: SparkSession, sf_dir: str, mangle: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    li = lineitem(spark, sf_dir)
    return li.select(F.col("l_orderkey").cast("string").alias("entry"),
                     (F.col("l_linenumber") - 1).cast("long").alias("line_no"),
                     mangle(F.concat(F.lit(" T"), _digit(F.col("l_partkey")), F.lit(" "))).alias("line"))


def template_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-residue template files: per order, ATOM lines then CONECT lines."""
    li = lineitem(spark, sf_dir)
    entry = F.col("l_orderkey").cast("string")
    name = F.when(F.col("l_linenumber") == 1, F.lit(" N  ")).otherwise(
        F.concat(F.lit(" C"), _digit(F.col("l_partkey")), F.lit(" ")))
    atom = li.select(entry.alias("entry"), F.col("l_linenumber").cast("long").alias("line_no"), F.concat(
        F.lit("ATOM  "), F.lpad(F.col("l_linenumber").cast("string"), 5, " "), F.lit(" "), name, F.lit(" "),
        F.concat(F.lit("R"), F.lpad((F.col("l_orderkey") % 100).cast("string"), 2, "0")),
        F.lit(" A   1      0.000   0.000   0.000  1.00 20.00")).alias("line"))
    n = 1 + F.col("l_suppkey") % 4
    slots = F.concat(*(F.when(n > i, F.lpad(((F.col("l_partkey") + i) % 100).cast("string"), 5, " ")).otherwise(F.lit(""))
                       for i in range(4)))
    bad = F.when(F.col("l_suppkey") % 7 == 0, F.lit("  ")).otherwise(F.lit(""))
    conect = li.select(entry.alias("entry"), (F.col("l_linenumber") + 100).cast("long").alias("line_no"), F.concat(
        F.lit("CONECT"), F.lpad(F.col("l_linenumber").cast("string"), 5, " "), slots, bad).alias("line"))
    return atom.unionByName(conect)


# ---- named queries ------------------------------------------------------------------------

def _r(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (and turn -0.0 into 0.0) for engine-independent comparison."""
    cols = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "double":
            cols.append((F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


class Ctx:
    """Shared inputs of one query; its line items, and stages, are written to the checkpoint folder once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.topo = fixture_topology(spark)
        self._src: dict[str, DataFrame] = {}

    @cached_property
    def mat(self) -> Materializer:
        return Materializer(self.spark, buckets=bucket_count(self.spark, self.sf_dir))

    @cached_property
    def items(self) -> DataFrame:
        """The line items in buckets of whole entries, as files hold their entries whole.  Stored by another name:
        Spark takes unions of a table's own columns for rows of unknown places."""
        li = items(self.spark, self.sf_dir).withColumnRenamed("entry", "order")
        return self.mat(li, "items", ["order"]).withColumnRenamed("order", "entry")

    def built(self, name: str) -> DataFrame:
        build = {"structure_atoms": structure_atoms, "structure_lines": structure_lines, "qc_lines": qc_lines}[name]
        return build(self.spark, self.sf_dir, self.items)

    # Atoms and lines are some fifty times the line items, so only those are written; each reader unfolds them (as
    # plain columns: Catalyst cannot fold the text building into the scan).
    def source(self, name: str) -> DataFrame:
        if name not in self._src:
            made = self.built(name)
            self._src[name] = settled(made, ["line"]) if "line" in made.columns else made
        return self._src[name]

    def places(self, name: str) -> DataFrame:
        """The entries of a source's rows, with nothing else built."""
        return self.built(name).select("entry")

    def atoms(self) -> DataFrame:
        return number_residues(self.source("structure_atoms"), materialize=self.mat).select(
            "entry", "chainid", "resseq", "icode", "rescounter", "resname", "atomname", "x", "y", "z")

    def stages(self, legacy_y: bool = False) -> Stages:
        return Stages(self.atoms(), self.topo, legacy_y, self.mat)

    def checked(self):
        return check_lines(self.source("qc_lines"), self.topo, materialize=self.mat, counted=self.places("qc_lines"))


def _q(fn: Callable[[Ctx], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _r(fn(Ctx(spark, sf_dir)))
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def q_number_residues(c: Ctx): return c.atoms()
def q_chain_ends(c: Ctx): return chain_ends(c.atoms())
def q_site_positions(c: Ctx): return site_positions(c.stages().pdb, c.topo)
def q_orient_sites(c: Ctx): return c.stages().cg
def q_assign_sites(c: Ctx): return assign_sites(mark_chain_ends(c.atoms()), c.topo).drop("is_end")
def q_to_site_frame(c: Ctx): return c.stages().relative
def q_frame_moments(c: Ctx): return c.stages().moments
def q_from_site_frame(c: Ctx): return c.stages().labframe
def q_corrected_predictor(c: Ctx): return c.stages().predictor
def q_regression_pairs(c: Ctx): return c.stages().pairs
def q_fit_corrections(c: Ctx): return c.stages().cov
def q_fit_corrections_legacy_y(c: Ctx): return c.stages(legacy_y=True).cov


def q_fit_ranks(c: Ctx):
    """R4 over predictors of every shape: the rank is found whatever the rotation, shift and scale."""
    p = c.stages().pairs
    shapes = F.inline(F.array(*(F.struct(F.lit(n).alias("variant"), *(F.expr(e).alias(f"q{a}") for e, a in zip(v, "xyz")))
                                for n, v in PREDICTOR_SHAPES.items())))
    t = p.select("resname", "atomname", "yx", "yy", "yz", shapes)
    q = V3.named("q")
    t = t.select("*", (F.lit(3.0) / F.lit(5.0) * q.x - F.lit(4.0) / F.lit(5.0) * q.y).alias("rx"),
                 (F.lit(4.0) / F.lit(5.0) * q.x + F.lit(3.0) / F.lit(5.0) * q.y).alias("ry"))
    t = t.select("*", (F.lit(5.0) / F.lit(13.0) * F.col("ry") - F.lit(12.0) / F.lit(13.0) * q.z).alias("sy"),
                 (F.lit(12.0) / F.lit(13.0) * F.col("ry") + F.lit(5.0) / F.lit(13.0) * q.z).alias("sz"))
    scales = F.explode(F.array(*(F.struct(F.lit(k).alias("scale"), F.lit(f).alias("by")) for k, f in PREDICTOR_SCALES.items())))
    t = t.select("*", scales.alias("k"))
    moved = [((F.col(a) + F.lit(shift)) * F.col("k.by")).alias(p) for a, shift, p in zip(("rx", "sy", "sz"), PREDICTOR_SHIFT, ("px", "py", "pz"))]
    cov = R.fit_corrections(t.select("resname", F.concat_ws(":", "atomname", "variant", "k.scale").alias("atomname"), "yx", "yy", "yz", *moved))
    part = F.split("atomname", ":")
    by = F.create_map(*(F.lit(x) for kv in PREDICTOR_SCALES.items() for x in kv))
    return cov.select("resname", part[0].alias("atomname"), part[1].alias("variant"), part[2].alias("scale"), "rank",
                      F.round("condition", 4).alias("condition"), F.col("slopexx").isNotNull().alias("fitted"),
                      F.round(F.col("slopexx") * by[part[2]], 5).alias("slope"))


def q_apply_corrections(c: Ctx): return c.stages().residuals
def q_direct_rmsd(c: Ctx): return direct_rmsd(c.stages().moments, c.topo)
def q_corrected_rmsd(c: Ctx): return corrected_rmsd(c.stages().residuals)
def q_rmsd_report(c: Ctx): return c.stages().rmsd
def q_rmsd_report_legacy_y(c: Ctx): return c.stages(legacy_y=True).rmsd
def q_scan_atoms(c: Ctx): return scan_atoms(c.source("qc_lines"))
def q_entry_errors(c: Ctx): return c.checked().errors
def q_clean_atoms(c: Ctx): return c.checked().clean
def q_duplicate_atoms(c: Ctx): return duplicate_atoms(c.checked().numbered)


def q_pipeline_rmsd(c: Ctx):
    """Text lines -> QC -> numbering -> sites -> moments -> corrections -> rmsd, end to end."""
    errors, st = analyse_lines(c.spark, c.source("structure_lines"), c.topo, materialize=c.mat, counted=c.places("structure_lines"))
    return st.rmsd


def q_pipeline_errors(c: Ctx):
    """The error table of the same analysis, over the lines with defects."""
    errors, _ = analyse_lines(c.spark, c.source("qc_lines"), c.topo, materialize=c.mat, counted=c.places("qc_lines"))
    return errors


def q_direct_atoms(c: Ctx):
    """J13 with the report's moments: which measured atoms are not corrected ones."""
    return c.stages().moments.join(F.broadcast(c.topo.direct_atoms()), ["resname", "atomname"], "left_semi").select(
        "resname", "siteid", "atomname", "count")


def q_bond_edges(c: Ctx):
    lines = template_lines(c.spark, c.sf_dir)
    return T.bond_edges(T.bonds_with_residues(lines, T.parse_template_atoms_with_position(lines)))


def q_written_report(c: Ctx):
    """K1-K3: the report and its moments published as one version, found by the pointer and read back."""
    st = c.stages()
    publish(c.spark, f"{c.mat.root}/out", {"moments": st.moments, "rmsd": st.rmsd})
    return read_results(c.spark, f"{c.mat.root}/out")["rmsd"]


def write_lines(lines: DataFrame, path: str, suffix: str) -> None:
    """Text files ``folder=<n>/*.<suffix>.gz``, one for each ``folder``, lines in order."""
    whole = lines if lies_whole(lines, "folder") else lines.repartition("folder")
    (whole.sortWithinPartitions("folder", "entry", "line_no", "line").select("folder", "line")
     .write.partitionBy("folder").options(
        extension=suffix, compression="gzip", sep="\t", quote="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path))


def q_read_files(c: Ctx):
    """S1 + S2 + F3: real files in.  The lines with defects are written as files of 1,000 order keys
    each, next to files of another suffix, then found by suffix, read in order and scanned."""
    root = f"{c.mat.root}/files"
    li = items(c.spark, c.sf_dir).withColumn("file", F.expr(f"cast(entry AS bigint) div {FILE_ORDERS}"))
    li = c.mat(li, "file_items", ["file"]).withColumnRenamed("file", "folder")
    lines = settled(qc_lines(c.spark, c.sf_dir, li, ("folder", "entry")), ["line"])
    write_lines(lines, f"{root}/structures", "ent")
    write_lines(lines.where(F.col("line").startswith("MODEL")), f"{root}/others", "txt")
    return scan_records(read_structure_lines(c.spark, root, compressed=True)).select(
        F.regexp_extract("file_path", r"folder=(\d+)", 1).cast("long").alias("folder"), "line_no", "record", "altloc",
        "atomname", "resname", "chainid", "resseq", "icode", "x", "y", "z", "malformed_at")


def q_site_director_layout(c: Ctx): return T.parse_site_directors(director_lines(c.spark, c.sf_dir))
def q_site_member_layout(c: Ctx): return T.parse_site_members(member_lines(c.spark, c.sf_dir))
def q_correction_layout(c: Ctx): return T.parse_corrections(correction_lines(c.spark, c.sf_dir))
def q_terminus_layout(c: Ctx): return T.terminus_layout(terminus_lines(c.spark, c.sf_dir), by=["entry"])


def q_layout_rejects(c: Ctx):
    """What the parsers refuse, with the reason, over lines of which most are spoilt."""
    a = (c.spark, c.sf_dir, _mangled)
    found = {"directors": T.reject_site_directors(director_lines(*a)), "members": T.reject_site_members(member_lines(*a)),
             "corrections": T.reject_corrections(correction_lines(*a)), "terminus": T.reject_terminus(terminus_lines(*a), ["entry"])}
    return reduce(DataFrame.unionByName, (d.select(F.lit(n).alias("layout"), "line", "reason") for n, d in found.items()))


def q_layout_rows(c: Ctx):
    """The rows of the sound lines among them."""
    a = (c.spark, c.sf_dir, _mangled)
    found = {"directors": T.parse_site_directors(director_lines(*a)), "members": T.parse_site_members(member_lines(*a)),
             "corrections": T.parse_corrections(correction_lines(*a)), "terminus": T.parse_terminus(terminus_lines(*a), ["entry"])}
    return reduce(DataFrame.unionByName, (d.select(
        F.lit(n).alias("layout"), F.concat_ws("|", *(F.col(k).cast("string") for k in sorted(d.columns))).alias("row")) for n, d in found.items()))


def q_topology_conflicts(c: Ctx):
    """The repeated keys of a topology whose tables are read from many lines."""
    a = (c.spark, c.sf_dir)
    return T.Topology(
        atoms=T.with_terminal_hydrogens(T.parse_template_atoms(template_lines(*a))), directors=T.parse_site_directors(director_lines(*a)),
        members=T.parse_site_members(member_lines(*a)), corrections=T.parse_corrections(correction_lines(*a)),
        terminus=T.parse_terminus(terminus_lines(*a), ["entry"]).select("atom1", "atom2", "atom3")).key_conflicts()


def q_bond_faults(c: Ctx):
    """Dangling and one-way edges of the sound bond records."""
    lines = template_lines(c.spark, c.sf_dir)
    atoms = T.parse_template_atoms_with_position(lines)
    return T.bond_faults(T.bond_edges(T.bonds_with_residues(lines, atoms)),
                         T.with_terminal_hydrogens(atoms.select("resname", "atomname", "serial")))


def q_template_atoms(c: Ctx):
    return T.with_terminal_hydrogens(T.parse_template_atoms(template_lines(c.spark, c.sf_dir)))


def q_scan_bonds(c: Ctx):
    lines = template_lines(c.spark, c.sf_dir)
    return T.bonds_with_residues(lines, T.parse_template_atoms_with_position(lines))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: _q(fn) for name, fn in list(globals().items()) if name.startswith("q_") and callable(fn)
}

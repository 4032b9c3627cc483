"""Topology: which atoms each residue type has, how they group into oriented sites, which
three atoms orient each site, which atoms close a chain, and which atom predicts which.

The topology is *input*.  It can be parsed from the usual fixed-width parameter files
(``read_topology``) or given as rows (``Topology.from_rows``).  All parsers take a DataFrame
of text lines, so they run the same on a folder of files or on lines built by Spark.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orisite.functions.fixed import char, field, int_field

# Names of the two extra amino-terminus hydrogens added to every residue type.
H1_NAME = " H1 "
H3_NAME = " H3 "
# Fixed value: the atom every H1/H3 bond attaches to.
N_NAME = " N  "

ATOMS_SCHEMA = "resname string, atomname string, serial int"
DIRECTORS_SCHEMA = "resname string, siteid int, sitetype int, atom1 string, atom2 string, atom3 string"
MEMBERS_SCHEMA = "resname string, atomname string, siteid int"
TERMINUS_SCHEMA = "atom1 string, atom2 string, atom3 string"
CORRECTIONS_SCHEMA = "resname string, atom1 string, atom2 string"
#: The columns that tell the rows of each topology table apart; the terminus has one row.
KEYS = {"atoms": ["resname", "atomname"], "directors": ["resname", "siteid"], "members": ["resname", "atomname"],
        "terminus": [], "corrections": ["resname", "atom1"]}
#: Faults that an error message names at most.
SHOWN = 20


@dataclass(frozen=True)
class Topology:
    """Five small parameter tables.  Their size is fixed by the chemistry (a few hundred rows),
    never by the number of structures, which is what makes broadcasting them safe."""

    atoms: DataFrame  # resname, atomname, serial  (template atoms + H1/H3)
    directors: DataFrame  # resname, siteid, sitetype, atom1, atom2, atom3
    members: DataFrame  # resname, atomname, siteid
    terminus: DataFrame  # atom1, atom2, atom3  (one row)
    corrections: DataFrame  # resname, atom1 (corrected), atom2 (correcting)

    @classmethod
    def from_rows(cls, spark: SparkSession, *, atoms, directors, members, terminus, corrections,
                  add_terminal_hydrogens: bool = True) -> "Topology":
        atoms_df = spark.createDataFrame(list(atoms), ATOMS_SCHEMA)
        if add_terminal_hydrogens:
            atoms_df = with_terminal_hydrogens(atoms_df)
        return cls(
            atoms=atoms_df,
            directors=spark.createDataFrame(list(directors), DIRECTORS_SCHEMA),
            members=spark.createDataFrame(list(members), MEMBERS_SCHEMA),
            terminus=spark.createDataFrame(list(terminus), TERMINUS_SCHEMA),
            corrections=spark.createDataFrame(list(corrections), CORRECTIONS_SCHEMA),
        )

    def key_conflicts(self) -> DataFrame:
        """``(table, key, rows, variants)`` of every key that has more than one row, in any of the five
        tables, by one aggregate.  A join on such a key would multiply atoms without a word."""
        each = [getattr(self, table).select(
            F.lit(table).alias("table"), F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key)).alias("key"),
            F.to_json(F.struct(F.col("*"))).alias("row")) for table, key in KEYS.items()]
        rows = functools.reduce(DataFrame.unionByName, each)
        return rows.groupBy("table", "key").agg(F.count("*").alias("rows"), F.countDistinct("row").alias("variants")).where("rows > 1")

    def require_keys(self) -> "Topology":
        """This topology, or ValueError with the first rows that repeat a key.  Checked once."""
        if not getattr(self, "_keys_hold", False):
            bad = self.key_conflicts().orderBy("table", "key").limit(SHOWN).collect()
            if bad:
                raise ValueError("the topology has repeated keys: " + "; ".join(
                    f"{r.table} {r.key!r} {r.rows} times ({r.variants} different)" for r in bad))
            object.__setattr__(self, "_keys_hold", True)
        return self

    # ---- derived lists (A1, J13, U2) -------------------------------------------------
    def residue_types(self) -> DataFrame:
        """Known residue names (distinct projection, A1)."""
        return self.atoms.select("resname").distinct()

    def terminus_atoms(self) -> DataFrame:
        """The three chain-closing atom names as rows ``(atomname, role)``."""
        t = self.terminus
        return t.select(F.inline(F.array(*(
            F.struct(F.col(f"atom{k}").alias("atomname"), F.lit(k).alias("role")) for k in (1, 2, 3)))))

    def director_roles(self) -> DataFrame:
        """Directors exploded to ``(resname, siteid, role, atomname)``: one row per role."""
        d = self.directors
        return d.select("resname", "siteid", F.inline(F.array(*(
            F.struct(F.lit(k).alias("role"), F.col(f"atom{k}").alias("atomname")) for k in (1, 2, 3)))))

    def correcting_atoms(self) -> DataFrame:
        return self.corrections.select("resname", F.col("atom2").alias("atomname")).distinct()

    def corrected_atoms(self) -> DataFrame:
        return self.corrections.select("resname", F.col("atom1").alias("atomname")).distinct()

    def direct_atoms(self) -> DataFrame:
        """Atoms measured directly, i.e. not corrected (J13: anti join, keys never NULL)."""
        return self.atoms.select("resname", "atomname").join(
            self.corrected_atoms(), ["resname", "atomname"], "left_anti")


def with_terminal_hydrogens(atoms: DataFrame) -> DataFrame:
    """S3 tail: per residue type add H1 (max serial + 1) and H3 (max serial + 2)."""
    top = atoms.groupBy("resname").agg(F.max("serial").alias("_m"))
    extra = top.select("resname", F.inline(F.array(
        F.struct(F.lit(H1_NAME).alias("atomname"), (F.col("_m") + 1).alias("serial")),
        F.struct(F.lit(H3_NAME).alias("atomname"), (F.col("_m") + 2).alias("serial")))))
    return atoms.unionByName(extra)


# ---- text parsers (input: DataFrame with a ``line`` column) ---------------------------
#
# Every non-blank line is parsed or rejected, whole: ``parse_*`` gives the rows of the sound lines and
# ``reject_*`` the other lines with a reason.

_PLACE = ["entry", "line_no"]


def _visible(c: Column) -> Column:
    return F.trim(c) != ""


def _rejected(lines: DataFrame, reason: Column) -> DataFrame:
    place = [c for c in _PLACE if c in lines.columns]
    return lines.filter(_visible(F.col("line"))).select(*place, "line", reason.alias("reason")).filter(F.col("reason").isNotNull())


def _sound(lines: DataFrame, reason: Column) -> DataFrame:
    return lines.filter(_visible(F.col("line")) & reason.isNull())


def _piece(start: Column, length: int) -> Column:
    return F.substring(F.col("line"), start, F.lit(length))


def _director_fault() -> Column:
    n = F.when(char("line", 3).rlike("^[0-9]$"), char("line", 3).try_cast("int"))
    groups = F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)
    untyped = F.exists(groups, lambda i: ~_piece(i * 13 + 5, 1).rlike("^[0-9]$"))
    nameless = F.exists(groups, lambda i: ~(_visible(_piece(i * 13 + 6, 4)) & _visible(_piece(i * 13 + 10, 4)) & _visible(_piece(i * 13 + 14, 4))))
    return (F.when(n.isNull(), "unreadable site count").when(n == 0, "no sites").when(F.length("line") < n * 13 + 4, "line too short")
            .when(untyped, "unreadable site type").when(nameless, "blank atom name"))


def parse_site_directors(lines: DataFrame) -> DataFrame:
    """S5.  ``resname`` (3), site count (1), then per site 13 chars: type (1), three 4-char atoms.
    ``siteid`` is the group's position in the line; what follows the last group is ignored."""
    n = char("line", 3).try_cast("int")
    g = _sound(lines, _director_fault()).select(field("line", 0, 3).alias("resname"), "line",
                                                F.explode(F.sequence(F.lit(0), n - 1)).alias("siteid"))
    off = F.col("siteid") * 13
    return g.select(
        "resname", "siteid", _piece(off + 5, 1).try_cast("int").alias("sitetype"),
        *(_piece(off + 6 + 4 * k, 4).alias(f"atom{k + 1}") for k in range(3)))


def reject_site_directors(lines: DataFrame) -> DataFrame:
    return _rejected(lines, _director_fault())


def _member_count() -> Column:
    return F.floor((F.length("line") - 3) / 5).cast("int")


def _member_fault() -> Column:
    n = _member_count()
    groups = F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)
    return (F.when(n < 1, "no members").when((F.length("line") - 3) % 5 == 4, "cut member")
            .when(F.exists(groups, lambda i: ~_piece(i * 5 + 8, 1).rlike("^[0-9]$")), "unreadable site id")
            .when(F.exists(groups, lambda i: ~_visible(_piece(i * 5 + 4, 4))), "blank atom name"))


def parse_site_members(lines: DataFrame) -> DataFrame:
    """S6.  ``resname`` (3), then 5-char groups: atom name (4), site id (1).  One to three characters
    after the last group are ignored; four are a member without its site id."""
    g = _sound(lines, _member_fault()).select(field("line", 0, 3).alias("resname"), "line",
                                              F.explode(F.sequence(F.lit(0), _member_count() - 1)).alias("_i"))
    off = F.col("_i") * 5
    return g.select("resname", _piece(off + 4, 4).alias("atomname"), _piece(off + 8, 1).try_cast("int").alias("siteid"))


def reject_site_members(lines: DataFrame) -> DataFrame:
    return _rejected(lines, _member_fault())


def _terminus(lines: DataFrame, by: list[str]) -> DataFrame:
    pick = [F.max(F.when(F.col("line_no") == k, F.col("line"))).alias(f"_line{k}") for k in range(3)]
    return lines.groupBy(*by).agg(*pick)


def _terminus_atoms(groups: DataFrame, by: list[str]) -> DataFrame:
    return groups.select(*by, *(field(f"_line{k}", 0, 4).alias(f"atom{k + 1}") for k in range(3)))


def _terminus_fault(k: int) -> Column:
    line = F.col(f"_line{k}")
    return F.when(line.isNull(), "missing line").when((F.length(line) < 4) | ~_visible(F.substring(line, 1, 4)), "short atom name")


def parse_terminus(lines: DataFrame, by: list[str] | None = None) -> DataFrame:
    """S7.  Lines 0, 1, 2 (first four characters each) pivoted to one row (per ``by`` group,
    e.g. per file), if all three are sound."""
    sound = functools.reduce(lambda a, b: a & b, (_terminus_fault(k).isNull() for k in range(3)))
    return _terminus_atoms(_terminus(lines, by or []).filter(sound), by or [])


def terminus_layout(lines: DataFrame, by: list[str] | None = None) -> DataFrame:
    """S7 over every group, sound or not: an atom whose line is missing is NULL.  ``reject_terminus`` has the
    reasons."""
    return _terminus_atoms(_terminus(lines, by or []), by or [])


def reject_terminus(lines: DataFrame, by: list[str] | None = None) -> DataFrame:
    faults = F.array(*(F.struct(F.lit(k).cast("long").alias("line_no"), F.coalesce(f"_line{k}", F.lit("")).alias("line"),
                                _terminus_fault(k).alias("reason")) for k in range(3)))
    return _terminus(lines, by or []).select(*(by or []), F.inline(faults)).filter(F.col("reason").isNotNull())


def _correction_fault() -> Column:
    return F.when(F.length("line") < 11, "line too short").when(~(_visible(field("line", 3, 7)) & _visible(field("line", 7, 11))), "blank atom name")


def parse_corrections(lines: DataFrame) -> DataFrame:
    """S8.  ``resname`` 0:3, corrected atom 3:7, correcting atom 7:11."""
    return _sound(lines, _correction_fault()).select(
        field("line", 0, 3).alias("resname"), field("line", 3, 7).alias("atom1"), field("line", 7, 11).alias("atom2"))


def reject_corrections(lines: DataFrame) -> DataFrame:
    return _rejected(lines, _correction_fault())


def reject_template_atoms(lines: DataFrame) -> DataFrame:
    """Template ATOM records that are cut or have an unreadable serial number."""
    atoms = lines.filter(field("line", 0, 6) == "ATOM  ")
    return _rejected(atoms, F.when(F.length("line") < 20, "line too short").when(int_field("line", 6, 11).isNull(), "unreadable serial"))


def parse_template_atoms(lines: DataFrame) -> DataFrame:
    """S3 head: template ``ATOM  `` records -> ``(resname, atomname, serial)``."""
    return lines.filter(field("line", 0, 6) == "ATOM  ").select(
        field("line", 17, 20).alias("resname"), field("line", 12, 16).alias("atomname"),
        int_field("line", 6, 11).alias("serial"))


def parse_template_atoms_with_position(lines: DataFrame) -> DataFrame:
    """Template ATOM records keeping their file and line: ``(entry, line_no, resname, atomname, serial)``."""
    return lines.filter(field("line", 0, 6) == "ATOM  ").select(
        "entry", "line_no", field("line", 17, 20).alias("resname"), field("line", 12, 16).alias("atomname"),
        int_field("line", 6, 11).alias("serial"))


def parse_bonds(lines: DataFrame) -> DataFrame:
    """S4.  ``CONECT`` records -> ``(entry, selfserial, serial1..serial4, malformed)``.

    A record holds its own serial (6:11) and one to four 5-wide neighbour serials.  Lines are
    read without their newline, so a well-formed record has length 11 + 5 n; any other length, or
    a serial that cannot be read, is flagged ``malformed`` instead of stopping the run.
    """
    c = lines.filter(field("line", 0, 6) == "CONECT")
    length = F.length("line")
    # slot k (k >= 1) is read once the line is longer than 11 + 5 k characters
    nb = [int_field("line", 11, 16)] + [
        F.when(length >= 12 + 5 * k, int_field("line", 11 + 5 * k, 16 + 5 * k)) for k in (1, 2, 3)]
    own = int_field("line", 6, 11)
    unread = functools.reduce(lambda a, b: a | b, ((length >= 12 + 5 * k) & v.isNull() for k, v in enumerate(nb)))
    return c.select(
        "entry", "line_no", own.alias("selfserial"), *(v.alias(f"serial{k + 1}") for k, v in enumerate(nb)),
        (((length - 11) % 5 != 0) | (length < 16) | own.isNull() | unread).alias("malformed"))


def bonds_with_residues(lines: DataFrame, atoms_per_file: DataFrame) -> DataFrame:
    """S4 + J15: tag each bond row with its file's residue name and add N-H1, N-H3 both ways.

    ``atoms_per_file``: ``(entry, resname, atomname, serial)`` from the same template files.
    The residue name of a file is that of its last ATOM record; the N serial is found by an
    equi join (never a per-row lookup).
    """
    res = atoms_per_file.groupBy("entry").agg(
        F.max_by("resname", "line_no").alias("resname"), F.max("serial").alias("_m"))
    bonds = parse_bonds(lines).join(res, "entry").select(
        "resname", "selfserial", "serial1", "serial2", "serial3", "serial4", "malformed")
    n = atoms_per_file.filter(F.col("atomname") == N_NAME).select("entry", F.col("serial").alias("_n"))
    h = res.join(n, "entry").select("resname", "_n", F.inline(F.array(
        F.struct((F.col("_m") + 1).alias("_h")), F.struct((F.col("_m") + 2).alias("_h")))))
    null_int = F.lit(None).cast("int")
    extra = h.select("resname", F.inline(F.array(
        F.struct(F.col("_n").alias("selfserial"), F.col("_h").alias("serial1")),
        F.struct(F.col("_h").alias("selfserial"), F.col("_n").alias("serial1"))))).select(
        "resname", "selfserial", "serial1", null_int.alias("serial2"), null_int.alias("serial3"),
        null_int.alias("serial4"), F.lit(False).alias("malformed"))
    return bonds.unionByName(extra)


def bond_edges(bonds: DataFrame) -> DataFrame:
    """Adjacency rows ``(resname, src, dst)`` of the sound rows of the 4-slot bond table."""
    return bonds.where(~F.col("malformed")).select(
        "resname", F.col("selfserial").alias("src"),
        F.explode(F.array("serial1", "serial2", "serial3", "serial4")).alias("dst")).filter(F.col("dst").isNotNull())


def bond_faults(edges: DataFrame, atoms: DataFrame) -> DataFrame:
    """``(resname, src, dst, fault)``: edges from or to a serial that no atom of the residue type has, and
    edges without their reverse.  ``atoms``: ``(resname, serial)``.  Each distinct edge is listed once a fault."""
    e = edges.distinct()
    known = atoms.select("resname", "serial").distinct()
    back = e.select("resname", F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = [(e.join(known.withColumnRenamed("serial", "src"), ["resname", "src"], "left_anti"), "unknown source"),
             (e.join(known.withColumnRenamed("serial", "dst"), ["resname", "dst"], "left_anti"), "unknown target"),
             (e.join(back, ["resname", "src", "dst"], "left_anti"), "one-way")]
    return functools.reduce(DataFrame.unionByName, (
        df.select("resname", "src", "dst", F.lit(fault).alias("fault")) for df, fault in found))


# ---- files --------------------------------------------------------------------------

def read_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Every line of every file under ``path``: ``(entry, line_no, line)``.  Files are read
    whole so line order is kept; ``entry`` is the file name."""
    r = spark.read.option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    raw = r.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("entry"), "value")
    text = F.regexp_replace("value", r"\r?\n\z", "")  # a line break at the end begins no further line
    return raw.select("entry", F.posexplode(F.split(text, "\r?\n")).alias("line_no", "line"))


def topology_rejects(spark: SparkSession, templates: str, directors: str, members: str, terminus: str,
                     corrections: str) -> DataFrame:
    """``(entry, line_no, line, reason)`` of every line of the five inputs that is neither blank nor sound."""
    found = [reject_template_atoms(read_lines(spark, templates)), reject_site_directors(read_lines(spark, directors)),
             reject_site_members(read_lines(spark, members)), reject_terminus(read_lines(spark, terminus), ["entry"]),
             reject_corrections(read_lines(spark, corrections))]
    return functools.reduce(DataFrame.unionByName, (
        f.select("entry", F.col("line_no").cast("long").alias("line_no"), "line", "reason") for f in found))


def read_topology(spark: SparkSession, templates: str, directors: str, members: str,
                  terminus: str, corrections: str) -> Topology:
    """Parse the five parameter inputs (a folder of one-residue template files and four
    fixed-width text files).  A line that cannot be read, or a repeated key, raises ValueError."""
    bad = topology_rejects(spark, templates, directors, members, terminus, corrections).limit(SHOWN).collect()
    if bad:
        raise ValueError("unreadable topology lines: " + "; ".join(f"{r.entry}:{r.line_no}: {r.reason}: {r.line!r}" for r in bad))
    tlines = read_lines(spark, templates)
    t_atoms = parse_template_atoms(tlines)
    return Topology(
        atoms=with_terminal_hydrogens(t_atoms),
        directors=parse_site_directors(read_lines(spark, directors)),
        members=parse_site_members(read_lines(spark, members)),
        terminus=parse_terminus(read_lines(spark, terminus)),
        corrections=parse_corrections(read_lines(spark, corrections)),
    ).require_keys()


def read_bonds(spark: SparkSession, templates: str) -> DataFrame:
    """S4 over a template folder: the bond table including the H1/H3 bonds."""
    tlines = read_lines(spark, templates)
    return bonds_with_residues(tlines, parse_template_atoms_with_position(tlines))

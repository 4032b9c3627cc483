"""Positions in a site's local frame, back to the lab, and their moments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orisite.functions.vec import M3, V3, matvec

RESIDUE_KEY = ["entry", "chainid", "rescounter"]
MOMENT_COLUMNS = ["resname", "siteid", "atomname", "x", "y", "z", "dx", "dy", "dz", "rmsd", "count"]


def frame() -> M3:
    return M3(V3.cols("exx", "exy", "exz"), V3.cols("eyx", "eyy", "eyz"), V3.cols("ezx", "ezy", "ezz"))


def to_site_frame(atoms: DataFrame, cg: DataFrame) -> DataFrame:
    """G3 + J6.  ``relative``: every atom with a site, as (d = atom - origin) and its local
    coordinates (d.ex, d.ey, d.ez).  Atoms without a site (NULL siteid) or whose site was
    dropped fall out of the inner join.  Both sides are partitioned on the residue key, so
    the join adds no shuffle."""
    s = cg.select(*RESIDUE_KEY, "siteid", F.col("x").alias("_ox"), F.col("y").alias("_oy"),
                  F.col("z").alias("_oz"), *frame().alias("e"))
    j = atoms.select(*RESIDUE_KEY, "resname", "siteid", "atomname", "x", "y", "z").join(
        s, RESIDUE_KEY + ["siteid"])
    d = V3.cols("x", "y", "z") - V3.cols("_ox", "_oy", "_oz")
    j = j.select(*RESIDUE_KEY, "resname", "siteid", "atomname", *frame().alias("e"), *d.alias("x", "y", "z"))
    o = matvec(frame(), V3.cols("x", "y", "z"))
    return j.select(*RESIDUE_KEY, "resname", "siteid", "atomname", "x", "y", "z",
                    *o.alias("orientedx", "orientedy", "orientedz"))


def frame_moments(relative: DataFrame) -> DataFrame:
    """A3.  Per ``(resname, siteid, atomname)``: mean local position, *population* standard
    deviation per axis, their root-sum-square ``rmsd`` and the count.  At most a few hundred
    groups, so partial aggregation does nearly all the work and a hot group costs nothing."""
    o = ["orientedx", "orientedy", "orientedz"]
    m = relative.groupBy("resname", "siteid", "atomname").agg(
        *(F.avg(c).alias(a) for c, a in zip(o, "xyz")),
        *(F.stddev_pop(c).alias(a) for c, a in zip(o, ("dx", "dy", "dz"))),
        F.count("orientedx").alias("count"))
    return m.withColumn("rmsd", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")
                                       + F.col("dz") * F.col("dz"))).select(*MOMENT_COLUMNS)


def from_site_frame(local: V3, legacy_y: bool = False) -> V3:
    """G4.  ``origin + lx*ex + ly*ey + lz*ez`` with the site columns in scope.

    ``legacy_y=True`` reproduces a known slip of the original y component (its first term
    multiplies the *y* local coordinate by exy instead of x), for comparisons only.
    """
    e = frame()
    o = V3.cols("x", "y", "z")
    first_y = local.y if legacy_y else local.x
    return V3(o.x + local.x * e.r0.x + local.y * e.r1.x + local.z * e.r2.x,
              o.y + first_y * e.r0.y + local.y * e.r1.y + local.z * e.r2.y,
              o.z + local.x * e.r0.z + local.y * e.r1.z + local.z * e.r2.z)

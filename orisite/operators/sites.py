"""Coarse-grained sites with an origin and an orthonormal frame.

Every residue gets one site per director triple of its type; the last residue of each chain
also gets a terminus site (``siteid = -1``) directed by the three terminus atoms.  Director
atoms are matched *by name within the residue*, never through site membership (a director
may belong to another site).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orisite.functions.vec import V3, cross, dot, norm
from orisite.operators.numbering import mark_chain_ends
from orisite.sources.topology import Topology

TERMINUS_SITE = -1
RESIDUE_KEY = ["entry", "chainid", "rescounter"]
FRAME_COLUMNS = ["exx", "exy", "exz", "eyx", "eyy", "eyz", "ezx", "ezy", "ezz"]
SITE_COLUMNS = RESIDUE_KEY + ["resname", "siteid", "x", "y", "z"] + FRAME_COLUMNS


def site_positions(atoms: DataFrame, topology: Topology) -> DataFrame:
    """G1 (J1, J2, J3, P8).  ``(entry, chainid, rescounter, siteid, resname, a1x..a3z)``.

    Two broadcast joins, on (residue name, atom name) and, for chain ends, on the terminus atom name,
    each of which finds at most one row, bring every atom the list of (site, role) it directs; a
    grouped pivot by role then lines the three directors up.  The group key starts with the
    residue key, on which the atoms are already partitioned.  ``resname`` is that of the
    first director.  ``atoms`` needs ``is_end`` (see ``mark_chain_ends``).
    """
    role = F.struct("siteid", "role")
    regular = topology.director_roles().groupBy("resname", "atomname").agg(F.collect_list(role).alias("_regular"))
    end = topology.terminus_atoms().select("atomname", F.lit(TERMINUS_SITE).alias("siteid"), "role").groupBy("atomname").agg(
        F.collect_list(role).alias("_end"))
    a = (atoms.select(*RESIDUE_KEY, "resname", "atomname", "is_end", "x", "y", "z")
         .join(F.broadcast(regular), ["resname", "atomname"], "left").join(F.broadcast(end), "atomname", "left"))
    directs = F.concat(F.coalesce("_regular", F.array()), F.coalesce(F.when(F.col("is_end"), F.col("_end")), F.array()))
    hits = a.where(F.col("_regular").isNotNull() | (F.col("is_end") & F.col("_end").isNotNull())).select(
        *RESIDUE_KEY, "resname", "x", "y", "z", F.inline(directs))

    # A residue key may carry several residue names; directors are lined up on the key and
    # the site alone, and the name is the first director's.
    g = hits.groupBy(*RESIDUE_KEY, "siteid").agg(
        F.max(F.when(F.col("role") == 1, F.col("resname"))).alias("resname"),
        *(F.max(F.when(F.col("role") == k, F.col(c))).alias(f"a{k}{c}") for k in (1, 2, 3) for c in "xyz"))
    return g.select(*RESIDUE_KEY, "siteid", "resname", *(f"a{k}{c}" for k in (1, 2, 3) for c in "xyz"))


def orient_sites(positions: DataFrame, drop_degenerate: bool = True) -> DataFrame:
    """G2 (P4, P5).  Gram-Schmidt: ex = unit(a2 - a1); ey = unit of the part of (a3 - a1)
    normal to ex; ez = ex x ey.  Origin a1.  A missing director, coincident a1/a2 or collinear
    directors give a NULL frame (``try_divide``), and such sites are dropped.

    ``drop_degenerate=False`` keeps them with the NULL frame, for a caller that writes the
    table and filters on read: a filter on the frame placed here is pushed below these
    projections and inlined into one very large expression, so filtering a written column is
    much cheaper."""
    a1, a2, a3 = (V3.cols(f"a{k}x", f"a{k}y", f"a{k}z") for k in (1, 2, 3))
    d1 = a2 - a1
    p = positions.select(*RESIDUE_KEY, "resname", "siteid", *a1.alias("x", "y", "z"),
                         *d1.alias("_d1x", "_d1y", "_d1z"), *(a3 - a1).alias("_d2x", "_d2y", "_d2z"))
    d1 = V3.cols("_d1x", "_d1y", "_d1z")
    p = p.withColumn("_n1", norm(d1))
    ex = d1.div(F.col("_n1"))
    p = p.select("*", *ex.alias("exx", "exy", "exz"))
    ex = V3.cols("exx", "exy", "exz")
    d2 = V3.cols("_d2x", "_d2y", "_d2z")
    p = p.withColumn("_proj", dot(ex, d2))
    p = p.select("*", *(d2 - ex.scale(F.col("_proj"))).alias("_ux", "_uy", "_uz"))
    u = V3.cols("_ux", "_uy", "_uz")
    p = p.withColumn("_n2", norm(u))
    p = p.select("*", *u.div(F.col("_n2")).alias("eyx", "eyy", "eyz"))
    ey = V3.cols("eyx", "eyy", "eyz")
    p = p.select("*", *cross(ex, ey).alias("ezx", "ezy", "ezz"))
    p = p.select(*SITE_COLUMNS)
    return drop_degenerate_sites(p) if drop_degenerate else p


def drop_degenerate_sites(cg: DataFrame) -> DataFrame:
    """Keep oriented sites only.  ``eyx`` is NULL exactly when a director is missing, a1 = a2,
    or the directors are collinear (every norm is >= 0, and 0 turns into NULL)."""
    return cg.filter(F.col("eyx").isNotNull())


def assign_sites(atoms: DataFrame, topology: Topology) -> DataFrame:
    """J4 + J5 (P7, P8).  Adds ``siteid``: the member site of (resname, atomname), NULL when
    none; a terminus atom of a chain-end residue gets -1 instead.  ``atoms`` needs ``is_end``."""
    members = F.broadcast(topology.members.select("resname", "atomname", "siteid"))
    term = F.broadcast(topology.terminus_atoms().select("atomname", F.lit(True).alias("_term")).distinct())
    a = atoms.join(members, ["resname", "atomname"], "left").join(term, "atomname", "left")
    return a.withColumn("siteid", F.when(F.col("is_end") & F.col("_term").isNotNull(), F.lit(TERMINUS_SITE))
                        .otherwise(F.col("siteid"))).drop("_term")

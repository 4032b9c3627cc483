"""Linear backmapping corrections.

For each correction ``(resname, corrected atom, correcting atom)`` the mean local position
of the correcting atom (from its own site) is taken to the lab frame and then into the frame
of the corrected atom's site.  That *predictor* p and the centred local position y of the
corrected atom are paired per residue, and a 3-in/3-out least-squares line y ~ B p + c is
fitted per ``(resname, corrected atom)`` from population (co)variances: B = C S^-1 with
C = cov(y, p), S = cov(p, p).  The 3x3 inverse is written out in columns; nothing is
collected to the driver.

Broadcast sides are bounded by the topology: ``moments`` has at most two rows per topology
atom (its own site and the terminus site) and ``cov`` one row per correction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orisite.functions.vec import M3, V3, dot, eigenvalues3, inv3, matmul, matvec
from orisite.operators.frames import from_site_frame, frame
from orisite.sources.topology import Topology

RESIDUE_KEY = ["entry", "chainid", "rescounter"]
_AX = "xyz"
COV_COLUMNS = (["resname", "atomname"]
               + [f"pos_difference_av_{a}" for a in _AX] + [f"predicted_pos_av_{a}" for a in _AX]
               + [f"cov_cross_{a}{b}" for a in _AX for b in _AX] + [f"cov_self_{a}{b}" for a in _AX for b in _AX]
               + [f"intercept{a}" for a in _AX] + [f"slope{a}{b}" for a in _AX for b in _AX] + ["rank", "condition"])
#: An eigenvalue of the predictors' covariance counts towards the rank if it exceeds this share of the
#: largest, and the variance that rounding alone gives numbers as large as their mean: that of
#: ``ROUNDING`` times the mean.
RANK_TOLERANCE, ROUNDING = 1e-10, 64 * 2.0 ** -52


def predict_correcting(moments: DataFrame, cg: DataFrame, topology: Topology, legacy_y: bool = False) -> DataFrame:
    """R1 (G4, J7, P6).  ``correcting_labframe``: lab position of every correcting atom
    predicted from the mean local position in each regular site of each residue."""
    m = F.broadcast(moments.join(topology.correcting_atoms(), ["resname", "atomname"], "left_semi")
                    .select("resname", "siteid", "atomname", F.col("x").alias("_mx"),
                            F.col("y").alias("_my"), F.col("z").alias("_mz")))
    j = cg.filter(F.col("siteid") >= 0).join(m, ["resname", "siteid"])
    lab = from_site_frame(V3.cols("_mx", "_my", "_mz"), legacy_y)
    return j.select(*RESIDUE_KEY, "resname", F.col("atomname").alias("correctingatomname"), *lab.alias("x", "y", "z"))


def corrected_predictor(labframe: DataFrame, cg: DataFrame, topology: Topology) -> DataFrame:
    """R2 (J8).  ``correcting_correctedframe``: the predicted correcting atom in the local
    frame of the corrected atom's site, per residue and corrected atom.  The small
    correction/member tables are pre-joined and broadcast; the one join with ``cg`` is on
    the residue key both sides are partitioned by."""
    corr = topology.corrections.join(
        topology.members.select("resname", F.col("atomname").alias("atom1"), F.col("siteid").alias("_site")),
        ["resname", "atom1"])
    corr = F.broadcast(corr.select("resname", F.col("atom2").alias("correctingatomname"),
                                   F.col("atom1").alias("correctedatomname"), "_site"))
    l = labframe.join(corr, ["resname", "correctingatomname"]).select(
        *RESIDUE_KEY, F.col("resname"), "correctedatomname", F.col("_site").alias("siteid"),
        F.col("x").alias("_lx"), F.col("y").alias("_ly"), F.col("z").alias("_lz"))
    # (J8) site of the corrected atom, same residue and residue name
    j = l.join(cg, RESIDUE_KEY + ["siteid", "resname"])
    d = V3.cols("_lx", "_ly", "_lz") - V3.cols("x", "y", "z")
    j = j.select(*RESIDUE_KEY, "resname", "siteid", "correctedatomname",
                 *d.alias("_dx", "_dy", "_dz"), *frame().alias("e"))
    p = matvec(frame(), V3.cols("_dx", "_dy", "_dz"))
    return j.select(*RESIDUE_KEY, "resname", "siteid", "correctedatomname", *p.alias("x", "y", "z"))


def regression_pairs(relative: DataFrame, moments: DataFrame, predictor: DataFrame,
                     corrected: DataFrame | None = None) -> DataFrame:
    """R3 (J9, J10).  Centre each local position on its group mean (matched on resname,
    siteid and atom name), then pair it with the predictor of the same residue and atom.
    Output ``(residue key, resname, siteid, atomname, yx, yy, yz, px, py, pz)``; ``siteid``
    is the atom's own site.  ``corrected`` (``atomname``; the names that ``predictor`` may have) spares the other
    atoms the joins."""
    if corrected is not None:
        relative = relative.join(F.broadcast(corrected.select("atomname").distinct()), "atomname", "left_semi")
    m = F.broadcast(moments.select("resname", "siteid", "atomname", F.col("x").alias("_mx"),
                                   F.col("y").alias("_my"), F.col("z").alias("_mz")))
    c = relative.join(m, ["resname", "siteid", "atomname"]).select(
        *RESIDUE_KEY, "resname", "siteid", "atomname",
        (F.col("orientedx") - F.col("_mx")).alias("yx"), (F.col("orientedy") - F.col("_my")).alias("yy"),
        (F.col("orientedz") - F.col("_mz")).alias("yz"))
    p = predictor.select(*RESIDUE_KEY, F.col("correctedatomname").alias("atomname"),
                         F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"))
    return c.join(p, RESIDUE_KEY + ["atomname"])


def fit_corrections(pairs: DataFrame) -> DataFrame:
    """R4 (A4).  ``cov``: per ``(resname, atomname)`` the means, population cross- and
    self-covariances, slope B = C (S^-1)^T and intercept mean(y) - B mean(p), the ``rank`` of S and its
    ``condition`` number.  Predictors that lie in a plane, on a line or in a point (or fewer than four)
    have a rank below 3: then slope, intercept and condition are NULL.  The rank is told from the
    eigenvalues of S; a determinant of exactly 0 would miss nearly all such groups."""
    y = ["yx", "yy", "yz"]
    p = ["px", "py", "pz"]
    self_cov = {}
    for i in range(3):
        for j in range(i, 3):
            self_cov[(i, j)] = self_cov[(j, i)] = f"_s{i}{j}"
    aggs = ([F.avg(c).alias(f"pos_difference_av_{a}") for c, a in zip(y, _AX)]
            + [F.avg(c).alias(f"predicted_pos_av_{a}") for c, a in zip(p, _AX)]
            + [F.covar_pop(y[i], p[j]).alias(f"cov_cross_{_AX[i]}{_AX[j]}") for i in range(3) for j in range(3)]
            + [F.covar_pop(p[i], p[j]).alias(f"_s{i}{j}") for i in range(3) for j in range(i, 3)])
    g = pairs.groupBy("resname", "atomname").agg(*aggs)
    g = g.select("*", *(F.col(self_cov[(i, j)]).alias(f"cov_self_{_AX[i]}{_AX[j]}") for i in range(3) for j in range(3)))
    cross_m, self_m, mean = M3.named("cov_cross_"), M3.named("cov_self_"), V3.named("predicted_pos_av_")
    g = g.select("*", eigenvalues3(self_m).alias("_ev"))
    ev = [F.col("_ev")[k] for k in range(3)]
    g = g.select("*", F.greatest(ev[0] * RANK_TOLERANCE, dot(mean, mean) * ROUNDING ** 2).alias("_least"))
    g = g.select("*", sum(((e > F.col("_least")).cast("int") for e in ev), F.lit(0)).alias("rank"))
    full = F.col("rank") == 3
    g = g.select("*", F.when(full, ev[0] / F.when(full, ev[2])).alias("condition"))
    slope = matmul(cross_m, inv3(self_m).transpose())
    g = g.select("*", *slope.alias("_b"))
    g = g.select("*", *(F.when(full, F.col(f"_b{a}{b}")).alias(f"slope{a}{b}") for a in _AX for b in _AX))
    icpt = V3.named("pos_difference_av_") - matvec(M3.named("slope"), mean)
    return g.select("*", *icpt.alias("interceptx", "intercepty", "interceptz")).select(*COV_COLUMNS)


def apply_corrections(pairs: DataFrame, cov: DataFrame) -> DataFrame:
    """R5 (J11).  ``relative_corrected``: residual y - (c + B p) for regular-site atoms."""
    k = F.broadcast(cov.select("resname", "atomname", "interceptx", "intercepty", "interceptz",
                               *(f"slope{a}{b}" for a in _AX for b in _AX)))
    j = pairs.filter(F.col("siteid") >= 0).join(k, ["resname", "atomname"])
    px, py, pz = F.col("px"), F.col("py"), F.col("pz")
    fit = [F.col(f"intercept{a}") + F.col(f"slope{a}x") * px + F.col(f"slope{a}y") * py + F.col(f"slope{a}z") * pz
           for a in _AX]
    return j.select(*RESIDUE_KEY, "resname", "siteid", "atomname",
                    *((F.col(f"y{a}") - f).alias(a) for a, f in zip(_AX, fit)))

"""The RMSD report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orisite.sources.topology import Topology

RMSD_COLUMNS = ["resname", "siteid", "atomname", "dx", "dy", "dz", "rmsd", "count"]


def direct_rmsd(moments: DataFrame, topology: Topology) -> DataFrame:
    """Atoms measured directly keep the spread of their moments (incl. site -1).
    ``left_semi`` against the direct list (its keys are unique)."""
    return moments.join(F.broadcast(topology.direct_atoms()), ["resname", "atomname"], "left_semi").select(
        *RMSD_COLUMNS)


def corrected_rmsd(residuals: DataFrame) -> DataFrame:
    """A5: root mean square of the residuals per component and overall.  Rows whose fit was
    singular (NULL residual) are left out, so such a group has no row."""
    r = residuals.filter(F.col("x").isNotNull())
    g = r.groupBy("resname", "siteid", "atomname").agg(
        F.avg(F.col("x") * F.col("x")).alias("_mx"), F.avg(F.col("y") * F.col("y")).alias("_my"),
        F.avg(F.col("z") * F.col("z")).alias("_mz"), F.count("x").alias("count"))
    return g.select("resname", "siteid", "atomname", F.sqrt("_mx").alias("dx"), F.sqrt("_my").alias("dy"),
                    F.sqrt("_mz").alias("dz"), F.sqrt(F.col("_mx") + F.col("_my") + F.col("_mz")).alias("rmsd"),
                    "count")


def rmsd_report(moments: DataFrame, residuals: DataFrame, topology: Topology) -> DataFrame:
    """R6 (U1): direct atoms from the moments, union all corrected atoms from the residuals."""
    return direct_rmsd(moments, topology).unionByName(corrected_rmsd(residuals))

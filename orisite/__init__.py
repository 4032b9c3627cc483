"""Oriented-site structure statistics on Spark.

Structure files in, five result tables out: rejected entries with a reason, the clean atom
table, oriented coarse-grained sites, linear backmapping corrections and a per-atom-type
round-trip RMSD.  Every step is a DataFrame-in, DataFrame-out function built from Spark's
own joins, windows, aggregates and column expressions.
"""

from orisite.sources.topology import Topology

__all__ = ["Topology"]

"""DataFrame-in, DataFrame-out operators: QC, numbering, sites, frames, corrections, report."""

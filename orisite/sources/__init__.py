"""Sources (structure files, topology parameter files) and sinks (result tables)."""

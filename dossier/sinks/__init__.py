"""Writers for findings, reports, the run log and stage tables."""

"""Data quality on Spark: profile, scan, clean, group, normalize, validate and report."""

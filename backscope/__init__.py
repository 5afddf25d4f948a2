"""Backup-estate analytics on Spark: pure DataFrame-to-DataFrame operators with an explicit reference time."""

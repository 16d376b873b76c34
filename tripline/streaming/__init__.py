"""Continuous re-runs of the incremental ingest."""

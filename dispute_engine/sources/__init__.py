"""Inputs (benchmark parquet and the fixture views over it) and catalog I/O."""

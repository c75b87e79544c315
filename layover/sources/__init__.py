"""Schemas, table reads and writes, golden rows and views over the test tables."""

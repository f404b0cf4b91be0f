"""Registered queries: each pairs a Spark query over the test tables with its DuckDB oracle."""

"""Tablewright: table-analysis recipes as Spark DataFrame operators."""

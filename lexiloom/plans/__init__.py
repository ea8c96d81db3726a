"""Registered queries (`QUERIES`) and their DuckDB equivalents (`ORACLE`)."""

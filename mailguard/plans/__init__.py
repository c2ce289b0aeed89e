"""Registered queries (Spark builder + DuckDB oracle SQL) over the driver tables."""

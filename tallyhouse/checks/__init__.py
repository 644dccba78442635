"""Registered queries over the driver tables and the DuckDB text each is compared with."""

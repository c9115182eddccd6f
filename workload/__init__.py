"""Queries over the driver tables that exercise each operator, with DuckDB counterparts."""

"""Registered queries: each module has ``QUERIES`` (name -> callable) and ``SQL`` (name -> DuckDB text)."""

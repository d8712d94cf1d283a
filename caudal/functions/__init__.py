"""Native Column expressions (no Python UDFs)."""

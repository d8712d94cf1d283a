"""Reusable relational building blocks: every one is (DataFrame, ...) -> DataFrame."""

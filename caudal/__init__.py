"""Retail-banking analytics expressed as Spark DataFrame jobs."""

"""SQL that answers every query independently, for an engine other than Spark."""

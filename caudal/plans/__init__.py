"""The query catalogue: KPIs, lookups, fraud pipeline, history and report marts."""

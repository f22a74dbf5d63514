"""Resilience analytics over warehouse tables and their lineage, as Spark jobs."""

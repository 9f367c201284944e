"""Multi-tenant product analytics on Spark: ingest, store and query event data."""

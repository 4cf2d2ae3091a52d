"""Structured Streaming jobs: snapshot ingest, exactly-once raw append,
latest state per key, hourly stop activity, stream–static delay
enrichment and a per-batch freshness monitor."""

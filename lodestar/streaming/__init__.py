"""Streams: beliefs kept as state, event-time windows, resumable ingestion."""

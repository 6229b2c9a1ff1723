"""Structured Streaming: incremental feeds, change detection, idle timeouts, windowed counts, deduplication."""

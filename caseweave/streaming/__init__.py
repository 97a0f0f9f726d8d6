"""Structured Streaming versions of the sweep, the spike counts and the audit ingest."""

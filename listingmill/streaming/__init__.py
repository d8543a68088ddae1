"""Structured Streaming jobs: incremental upserts, first-seen messages, a stage machine with state."""

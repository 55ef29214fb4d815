"""Structured Streaming: change data capture, expiry timers, idempotent ingest."""

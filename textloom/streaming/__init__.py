"""Structured Streaming forms: incremental refresh and a per-key state machine."""

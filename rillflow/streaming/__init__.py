"""Structured Streaming forms: harness and stateful processors."""

"""Sinks with stated delivery guarantees."""

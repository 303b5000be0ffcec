"""Scalar helpers and sketches."""

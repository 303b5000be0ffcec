"""Batch forms of the operators: plain DataFrame plans."""

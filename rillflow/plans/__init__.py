"""Registered queries and the SQL layer."""

"""Sources of records, bounded and unbounded."""

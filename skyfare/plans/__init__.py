"""Jobs that read tables, apply operators and write tables."""

"""Column-level building blocks (no data access)."""

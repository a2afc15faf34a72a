"""Column-level building blocks and small in-task numeric helpers."""

"""Column functions and small per-file helpers."""

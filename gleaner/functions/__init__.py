"""Column expressions and the small helpers that run inside tasks."""

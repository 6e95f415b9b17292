"""Column expressions and the small Arrow helpers that run inside tasks."""

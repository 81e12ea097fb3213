"""Column expressions and driver-side helpers for text."""

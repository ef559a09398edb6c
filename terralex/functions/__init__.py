"""Column expressions and small driver-side geometry."""

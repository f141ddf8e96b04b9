"""Column expressions, session helpers and distributed ordering used by every operator."""

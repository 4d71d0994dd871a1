"""Column expressions: measures as aggregates, and text functions."""

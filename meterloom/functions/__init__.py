"""Column expressions: clock arithmetic, error measures, naming rules."""

"""Column expressions and naming rules of a table's coordinates."""

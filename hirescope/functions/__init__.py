"""Column-level helpers. All of them are expressions: no UDF, no action."""

"""Column-level helpers: missing values, conversions, column names."""

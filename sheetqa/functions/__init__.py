"""Column functions: Columns in, a Column out."""

"""Column functions: text, dates and numbers. Everything here is a built-in expression, no UDF."""

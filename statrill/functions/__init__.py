"""Column functions: numeric coercion, limits and constants."""

"""Column helpers: label sets and IEEE arithmetic."""

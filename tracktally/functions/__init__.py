"""Column helpers: text fields, dates, Poisson and normal arithmetic."""

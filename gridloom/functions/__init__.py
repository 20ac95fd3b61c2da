"""Column functions: each takes columns and gives a column, with the null, NaN and edge rules of sheets inside."""

"""Column expressions: parsing, clocks, ratios and labels."""

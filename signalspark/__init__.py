"""Analytics of case reports on Spark: pair counts, disproportionality signals, scoring and statistics."""

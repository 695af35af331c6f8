"""Column expressions: hashing, calendar features, bins and score labels."""

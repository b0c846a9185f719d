"""Column functions: parsing, normalising, hashing, fixed-point and probability arithmetic."""

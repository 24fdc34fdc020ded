"""Column functions: null rules, text keys, allometry and fixed values."""

"""Table schemas, readers, writers, staging, and the mapping of the test tables."""

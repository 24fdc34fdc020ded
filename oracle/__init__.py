"""The same queries in plain SQL, written apart from the Spark code."""

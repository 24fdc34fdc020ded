"""Forest-inventory analytics on Spark: trees to plots to a change panel to carbon."""

"""Repository analytics on Spark: source trees as tables, findings as queries."""

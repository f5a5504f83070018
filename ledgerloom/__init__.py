"""Construction-cost analytics on Spark: sources, expressions, operators, plans and streams."""

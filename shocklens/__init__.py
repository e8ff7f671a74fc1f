"""Market-disruption analytics as Spark DataFrame operators."""

"""Water-system analytics as Spark DataFrame operators."""

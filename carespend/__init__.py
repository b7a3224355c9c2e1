"""carespend: medical-cost analytics as Spark DataFrame operators."""

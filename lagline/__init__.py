"""Late-delivery risk analytics as plain Spark DataFrame operators."""

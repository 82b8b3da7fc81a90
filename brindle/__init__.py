"""brindle: inventory and web analytics as Spark DataFrame operators."""

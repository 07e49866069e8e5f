"""Field-ecology and micro-climate analytics as Spark DataFrame operators."""

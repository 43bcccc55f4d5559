"""Floating-car-data traffic analytics as composable Spark DataFrame operators."""

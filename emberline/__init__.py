"""Thermal-event analytics as Spark DataFrame operators."""

"""Tick analytics as composable Spark DataFrame operators."""

"""Behavioural signal analytics as Spark DataFrame operators."""

"""Factloom: evidence and fact analytics as Spark DataFrame operators."""

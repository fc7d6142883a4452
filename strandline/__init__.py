"""Ordered-stream analytics expressed as Spark DataFrame plans."""

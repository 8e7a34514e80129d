"""Spanloom: evidence retrieval and retrieval analytics as Spark DataFrame plans."""

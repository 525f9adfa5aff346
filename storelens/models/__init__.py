"""Spark ML pipelines: low-review risk and customer clusters."""

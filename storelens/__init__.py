"""Marketplace order analytics as lazy Spark DataFrame operators."""

from storelens.session import configure, materialize, release

__all__ = ["configure", "materialize", "release"]

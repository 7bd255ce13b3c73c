"""Nested-record analytics on Spark: paths, fan-out, expressions, pipelines and large-scale data operators."""

__version__ = "0.1.0"

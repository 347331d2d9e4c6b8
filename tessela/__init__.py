"""Spark-first analytics for region-annotated images and the data around them."""

__version__ = "0.1.0"

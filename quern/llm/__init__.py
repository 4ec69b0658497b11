"""Operators for large-scale training-data pipelines. Nothing else in quern imports this package."""

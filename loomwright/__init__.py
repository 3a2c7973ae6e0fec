"""Batch and streaming jobs for a content platform and its training data, on PySpark."""

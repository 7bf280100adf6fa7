"""Operators for large training-data pipelines; each module is one operator with its general interface."""

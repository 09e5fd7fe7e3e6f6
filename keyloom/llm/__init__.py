"""Operators for training-data pipelines.

Nothing else in the package imports this folder; it may be deleted as a whole.
"""

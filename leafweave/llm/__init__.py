"""Operators for large-scale training-data preparation.

Nothing else in the library imports this subpackage; it can be removed as a
whole.  Every operator is a function from DataFrames to a DataFrame, reads its
shared folder from the session (``spark.checkpoint.dir``) and survives lost
executors, because each intermediate result is either recomputable from its
inputs or written to that shared folder.
"""

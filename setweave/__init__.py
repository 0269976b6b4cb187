"""Sequence-set analytics and set reconciliation on Spark DataFrames."""

"""Replicate groups of tables as atomic units, on Spark DataFrames."""

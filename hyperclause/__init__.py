"""Symbolic graph analytics and corpus preparation, declared on PySpark DataFrames."""

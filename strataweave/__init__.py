"""Bayesian block clustering and the analytics around it, on Spark DataFrames."""

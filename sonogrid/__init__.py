"""Annotated acoustic time series as DataFrames, and operators over them."""

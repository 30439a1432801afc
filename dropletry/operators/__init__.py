"""Operators over DataFrames with the columns that each one names; none knows where its input comes from."""

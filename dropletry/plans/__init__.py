"""Registered queries: operators applied to the tables of a dataset folder, beside equivalent SQL."""

"""Relational operators of the usage engine; all take and return DataFrames."""

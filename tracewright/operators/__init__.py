"""Operators over DataFrames of facts."""

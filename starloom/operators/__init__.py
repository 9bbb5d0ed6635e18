"""Operators over DataFrames: joins, windows, preparation and statistics."""

"""Scalar and aggregate functions of the feature language as Spark columns."""

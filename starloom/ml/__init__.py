"""Scoring, training and prediction over feature DataFrames."""

"""Relational, quality, vector and analytics operators over DataFrames."""

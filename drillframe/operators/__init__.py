"""Operators: DataFrame to DataFrame, lazy, keyed by explicit keys, order and columns."""

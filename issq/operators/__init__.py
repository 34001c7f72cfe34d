"""Operators: DataFrame in, DataFrame out; nothing is collected inside unless stated."""

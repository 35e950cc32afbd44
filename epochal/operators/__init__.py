"""Core operators: DataFrame in, DataFrame out."""

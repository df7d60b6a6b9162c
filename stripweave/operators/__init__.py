"""Catalogue operators: DataFrame in, DataFrame out, all projects at once."""

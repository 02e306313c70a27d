"""Operators: DataFrame to DataFrame steps over files, pages, chunks and code."""

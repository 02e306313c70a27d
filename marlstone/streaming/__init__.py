"""Incremental maintenance of the chunk index."""

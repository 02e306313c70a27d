"""Where files come from: the catalog, checkouts, web mirrors, trees, tables."""

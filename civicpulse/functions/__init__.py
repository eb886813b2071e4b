"""Column builders and fixed catalogs."""

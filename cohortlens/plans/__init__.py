"""Queries over the test tables, one module per family of operators."""

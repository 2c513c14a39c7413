"""Readers of published files, write contracts and the Parquet lake."""

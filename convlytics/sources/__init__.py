"""Readers and writers: JSON collections, Parquet/CSV stores, model files."""

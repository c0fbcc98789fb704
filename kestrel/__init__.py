"""Kestrel: a PySpark library for fraud and public-safety analytics."""

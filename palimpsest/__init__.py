"""Versioned-table analytics as PySpark DataFrame plans."""

"""Readers and writers."""
from .tables import read_table, table_path

__all__ = ["read_table", "table_path"]

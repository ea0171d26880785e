"""Registered queries and their SQL oracles."""

#: Modules with ``QUERIES`` and ``SQL``.
CORE = ("integrity", "chunking", "knowledge", "catalog", "library", "chat", "records")

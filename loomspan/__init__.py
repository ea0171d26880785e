"""loomspan: Spark-first analytics over retrieval-oriented document collections."""

__version__ = "0.1.0"

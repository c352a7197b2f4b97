"""inkveil: find and rewrite sensitive values in large collections of text, on Spark."""

__version__ = "0.1.0"

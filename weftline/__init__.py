"""weftline: a Spark-first analytics engine for tabular, text and vector data."""

__version__ = "0.1.0"

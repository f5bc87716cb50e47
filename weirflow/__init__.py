"""weirflow: keyed event-stream analytics and data preparation on PySpark DataFrames."""

__version__ = "0.1.0"

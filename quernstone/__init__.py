"""Search, code-intelligence and data-processing operators expressed as Spark DataFrames."""

__version__ = "0.1.0"

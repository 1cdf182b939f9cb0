"""Pattern queries over language models and large text tables, on Spark DataFrames."""

__version__ = "0.1.0"

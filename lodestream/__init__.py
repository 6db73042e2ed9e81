"""lodestream: session analytics and training-data preparation on plain PySpark DataFrames."""

__version__ = "0.1.0"

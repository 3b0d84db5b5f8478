"""schemaloom: a semantic-metadata engine built on PySpark DataFrames."""

__version__ = "0.1.0"

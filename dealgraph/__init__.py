"""dealgraph: record linkage, quality and text analytics as Spark DataFrames."""

__version__ = "0.1.0"

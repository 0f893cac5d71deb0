"""Dictionary-based lemmatization and search normalization on Spark DataFrames."""

__version__ = "0.1.0"

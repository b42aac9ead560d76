"""Graph analytics on Spark: graphs are vertex and edge DataFrames, every analysis returns a DataFrame."""

__version__ = "0.1.0"

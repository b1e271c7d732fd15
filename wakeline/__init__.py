"""wakeline: event queries and data processing as plain Spark plans."""

__version__ = "0.1.0"

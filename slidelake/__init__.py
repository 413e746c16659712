"""slidelake: presentation packages as Spark tables."""

__version__ = "0.2.0"

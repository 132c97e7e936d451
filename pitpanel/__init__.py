"""Point-in-time panels on Spark: build them, prove them leak-free, measure what they add."""

__version__ = "0.1.0"

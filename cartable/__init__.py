"""cartable: classify collections of small text tables with Spark."""

__version__ = "0.1.0"

"""Posts about listed companies against their share prices, as Spark jobs."""

__version__ = "0.1.0"

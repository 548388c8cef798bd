"""bidlens: search relevance, personalisation and purchase analytics as Spark jobs."""

__version__ = "0.1.0"

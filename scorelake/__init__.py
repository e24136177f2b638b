"""Reward-scored caption corpora as Spark jobs."""

__version__ = "0.1.0"

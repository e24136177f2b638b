"""Structured Streaming jobs; they share their column functions with the batch jobs."""

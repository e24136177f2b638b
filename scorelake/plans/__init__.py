"""Epoch tables: which rank, worker and batch place every row takes, computed with Spark joins."""

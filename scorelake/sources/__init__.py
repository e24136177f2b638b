"""Readers and writers: shard archives, text tables, image folders, stored results."""

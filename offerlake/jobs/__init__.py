"""Batch jobs that own a read, a join and a write."""

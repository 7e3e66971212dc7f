"""Spark jobs that turn promotional messages and web pages into an offers table."""

"""Readers of messages, feeds, images and saved responses."""

"""Readers and writers of edge lists and compressed tables."""

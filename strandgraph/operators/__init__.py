"""Operators on edge lists, adjacency lists and compressed lists."""

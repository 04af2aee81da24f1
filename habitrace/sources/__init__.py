"""Readers and writers for point clouds, layout text and the driver tables."""

"""Streams of file changes and of maintenance runs."""

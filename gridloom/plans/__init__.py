"""Iterative reconstruction and the public API."""

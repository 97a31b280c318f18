"""Operators over token, node and count tables."""

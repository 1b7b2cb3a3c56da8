"""Decoding of segments as they arrive."""

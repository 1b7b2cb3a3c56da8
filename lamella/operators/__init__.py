"""Scans, data movement and the decoding schemes."""

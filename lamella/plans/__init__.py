"""Naming and choosing decoders."""

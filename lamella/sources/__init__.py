"""Encoded columns on disk, and tables as columns with positions."""

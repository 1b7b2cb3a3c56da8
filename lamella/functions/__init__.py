"""Scalar, bit and model functions as builders of Column expressions."""

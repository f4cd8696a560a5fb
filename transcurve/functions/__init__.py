"""Scalar, vector and criterion functions."""

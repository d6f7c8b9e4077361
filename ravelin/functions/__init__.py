"""Scalar functions, patterns and registered functions."""

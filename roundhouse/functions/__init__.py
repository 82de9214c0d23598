"""Scalar, statistical and geometric functions as column expressions."""

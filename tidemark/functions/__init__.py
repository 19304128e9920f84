"""Scalar rules as column expressions."""

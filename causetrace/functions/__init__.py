"""Numerical functions on small arrays."""

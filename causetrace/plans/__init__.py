"""Whole diagnoses, and the registered queries."""

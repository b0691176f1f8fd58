"""Whole plans: index objects, and the registered queries."""

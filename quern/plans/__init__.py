"""Whole plans: building an index, searching it, its status, and the catalogue of queries."""

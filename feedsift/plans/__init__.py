"""Whole-run plans and the registered queries."""

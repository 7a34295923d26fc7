"""Whole jobs composed of operators, and the catalogue of registered queries."""

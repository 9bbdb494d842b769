"""Queries composed of the operators."""

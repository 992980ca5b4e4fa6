"""Workflows built from several operators."""

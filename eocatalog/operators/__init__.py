"""Catalogue operators."""

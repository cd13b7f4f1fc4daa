"""Catalogue functions."""
